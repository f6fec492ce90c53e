"""Licence statements in texts: notice phrases and identifier tags with licence expressions.

A null text is empty and has no word. Rows with the same id are separate rows.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import arrow_map, shipped, texts

#: Phrases that are always looked for, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0-1.0",
    "dedicated to the public domain": "public-domain",
    "proprietary and confidential": "proprietary",
    "licensed under the apache license": "apache-2.0",
    "apache software license": "apache",
    "released under the mit license": "mit",
    "boost software license": "bsl-1.0",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software": "bsl-1.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "isc license": "isc",
    "zlib license": "zlib",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "gnu free documentation license": "gfdl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "creative commons zero": "cc0",
    "no rights reserved": "public-domain",
    "cc by 4 0": "cc-by-4.0",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
}
#: The words of the tags that a licence expression follows on the same line.
TAGS = ("spdx license identifier", "license", "licence")
TAG_LINE = re.compile(r"(?:spdx-license-identifier|(?<![\w-])licen[sc]e)[\"']?\s*[:=]\s*[\"']?([^\n\r]*)", re.I)
#: Licence names that have neither digit nor hyphen.
PLAIN_NAMES = set("mit isc zlib unlicense apache gpl lgpl agpl bsd mpl epl wtfpl postgresql python psf ruby perl vim x11 curl ncsa openssl artistic beerware proprietary".split())
#: How freely a licence lets its text be used, by the beginning of its identifier; the longest that fits counts.
FREEDOM = {
    "mit": 1.0,
    "bsd": 1.0,
    "apache": 1.0,
    "isc": 1.0,
    "zlib": 1.0,
    "unlicense": 1.0,
    "cc0": 1.0,
    "public-domain": 1.0,
    "cc-by": 0.9,
    "cc-by-sa": 0.6,
    "cc-by-nc": 0.2,
    "cc-by-nd": 0.2,
    "mpl": 0.6,
    "epl": 0.6,
    "lgpl": 0.5,
    "gpl": 0.3,
    "agpl": 0.2,
    "reserved": 0.0,
    "proprietary": 0.0,
    "bsl-1.0": 1.0,
    "wtfpl": 1.0,
    "ofl": 0.9,
    "psf": 1.0,
    "artistic": 0.8,
    "cddl": 0.6,
    "eupl": 0.4,
    "odbl": 0.5,
    "gfdl": 0.3,
    "sspl": 0.1,
    "busl": 0.1,
    "elastic": 0.1,
}
UNKNOWN_FREEDOM = 0.4
#: An exception lifts a licence this part of the way to full freedom.
EXCEPTION_LIFT = 0.5
#: What one statement of a kind adds to the certainty that the text is under a licence.
CERTAINTY = {"base": 0.6, "notice": 0.7, "tag": 0.95}

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"\(|\)|[a-z0-9._+:-]+")
#: Everything but digits, lower-case letters and bytes of other characters parts words.
_TABLE = bytes(b if b in set(b"0123456789" + string.ascii_lowercase.encode()) or b >= 0x80 else 32 for b in range(256))


def freedom(identifier: str) -> float:
    fits = [x for x in FREEDOM if identifier.startswith(x)]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN_FREEDOM


def postfix(expression: str | list[str]) -> list[str] | None:
    """The tokens of an expression, or of its text, with operators after their operands, by a shunting yard; None if it is not well formed."""
    tokens = TOKEN.findall(expression.lower()) if isinstance(expression, str) else expression
    out, stack, operand = [], [], True  # operand: one has to come next
    for token in tokens:
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def names_licence(token: str) -> bool:
    """Whether a token can be a licence or an exception: a known name, or one with a digit or a hyphen, as all others have."""
    bare = token.removesuffix("+")
    return bare in PLAIN_NAMES or re.fullmatch(r"[a-z](?=.*[0-9-])[a-z0-9._:+-]*", bare) is not None


def expression_tokens(text: str) -> list[str]:
    """The tokens of the longest well-formed expression that a line begins with; none if there is no such.

    It ends before the first word that cannot be a licence. A full stop at the
    end of a name is the sentence's, and an opening bracket that is never closed
    is left out.
    """
    tokens: list[str] = []
    for token in TOKEN.findall(text.lower()):
        token = token.rstrip(".:") if token not in "()" else token
        if not token or token not in PRECEDENCE and token not in "()" and not names_licence(token):
            break
        tokens.append(token)
    while tokens:
        for size in range(len(tokens), 0, -1):
            if postfix(tokens[:size]) is not None:
                return tokens[:size]
        if tokens[0] != "(":
            break
        tokens = tokens[1:]
    return []


def evaluate(expression: str | list[str]) -> tuple[list[str], float] | None:
    """The licences of an expression, and how freely its text may be used: the freest of ``or``, the least of ``and``.

    What stands after ``with`` is an exception, not a licence; it must follow a single licence.
    """
    tokens = postfix(expression)
    if tokens is None:
        return None
    stack: list[tuple[list[str], float]] = []
    for token in tokens:
        if token not in PRECEDENCE:
            stack.append(([token], freedom(token)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if len(right[0]) != 1 or len(left[0]) != 1:
                return None
            stack.append((left[0], left[1] + EXCEPTION_LIFT * (1 - left[1])))
        else:
            choose = min if token == "and" else max
            stack.append((left[0] + right[0], choose(left[1], right[1])))
    return stack[0]


def tagged(text: str) -> list[tuple[str, list[str], float]]:
    """The well-formed expressions after identifier tags, in normal spelling, with their licences and freedom."""
    out = []
    for m in TAG_LINE.finditer(text):
        tokens = expression_tokens(re.split(r"\*/|-->|#\}|[\"'`,;<>]", m.group(1))[0])
        found = evaluate(tokens)
        while tokens and found is None:  # a wrong use of "with"
            tokens = tokens[:-1]
            found = evaluate(tokens)
        if found:
            out.append((" ".join(tokens).replace("( ", "(").replace(" )", ")"), *found))
    return out


class Scanner:
    """One automaton of all phrases, each between blanks."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("notice", notices), ("base", base), ("tag", dict.fromkeys(tags, ""))):
            for phrase, label in phrases.items():
                kinds.setdefault(" " + phrase + " ", []).append((kind, label))
        for phrase, found in kinds.items():
            self.automaton.add_word(phrase, (len(phrase), found))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        """Words, base places, first and last of them, base labels, labels, certainty, expressions, freedom."""
        words = text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()
        line = b" ".join([b"", *words, b""]).decode("latin-1") if words else ""
        n_base, first, last, base, labels, has_tag = 0, None, None, set(), set(), False
        doubt, free, word, counted = 1.0, [], 0, 0
        for end, (size, found) in self.automaton.iter(line):
            begin = end - size + 1
            if begin >= counted:
                word += line.count(" ", counted, begin)
                at, counted = word, begin
            else:
                at = word - line.count(" ", begin, counted)
            for kind, label in found:
                if kind == "tag":
                    has_tag = True
                    continue
                if label not in labels:
                    doubt *= 1 - CERTAINTY[kind]
                labels.add(label)
                free.append(freedom(label))
                if kind == "base":
                    n_base += 1
                    base.add(label)
                    first = at if first is None else min(first, at)
                    last = at if last is None else max(last, at)
        expressions = tagged(text) if has_tag else []
        for _, licences, freely in expressions:
            labels.update(licences)
            free.append(freely)
            doubt *= 1 - CERTAINTY["tag"]
        return (
            len(words),
            n_base,
            first,
            last,
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            round(1 - doubt, 9),
            "\n".join(e for e, _, _ in expressions),
            min(free) if free else None,
        )


def scan(docs: DataFrame) -> DataFrame:
    """What ``Scanner.scan`` finds in each text. ``score`` says how surely the text is under a licence.

    ``freedom`` is that of the most restrictive statement, null without any.
    """
    made = shipped(docs.sparkSession, Scanner())
    names = "n_words n_base first_word last_word base_labels labels score expressions freedom".split()

    def rows(part):
        found = [made().scan(t) for t in texts(part.column(1))]
        return {"doc_id": part.column(0)} | {n: [f[i] for f in found] for i, n in enumerate(names)}

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        " score double, expressions string, freedom double"
    )
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)
