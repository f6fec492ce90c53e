"""Built-in keyword profiles.

Fixed values: terms and weights of the two presets and of the older one, in the
order their hits are listed.
"""

from __future__ import annotations

DEFAULT_PROFILE = "engineering-default"
PROPERTY_PROFILE = "surveying-legal-property"
OLDER_PROFILE = "engineering-older"

TITLE_BOOST, LENGTH_CAP, LENGTH_DIVISOR = 1.35, 1.25, 900.0

ENGINEERING_CORE = {
    "quality engineering": 3.4,
    "quality engineer": 3.0,
    "quality assurance": 2.6,
    "software quality": 2.8,
    "qa": 2.4,
    "qe": 1.8,
    "sdet": 3.0,
    "test automation": 3.2,
    "automation": 2.2,
    "software testing": 2.4,
    "systems test": 2.4,
    "system test": 2.4,
    "integration and test": 2.7,
    "integration & test": 2.7,
    "validation": 2.4,
    "verification": 2.1,
    "debug": 1.4,
    "troubleshooting": 1.6,
    "failure analysis": 1.6,
    "lab": 1.0,
    "python": 2.5,
    "linux": 2.5,
    "unix": 1.1,
    "bash": 1.4,
    "shell": 1.0,
    "kubernetes": 2.6,
    "openshift": 2.6,
    "containers": 1.8,
    "container": 1.5,
    "docker": 1.8,
    "helm": 1.3,
    "fedora": 1.0,
    "red hat": 1.0,
    "sre": 2.4,
    "site reliability": 2.4,
    "devops": 2.0,
    "devsecops": 2.0,
    "ci/cd": 1.8,
    "jenkins": 1.2,
    "gitlab": 1.0,
    "github actions": 1.0,
    "observability": 1.4,
    "prometheus": 1.2,
    "grafana": 1.0,
    "terraform": 1.4,
    "infrastructure as code": 1.5,
    "enterprise storage": 3.4,
    "storage": 2.4,
    "distributed storage": 1.8,
    "block storage": 1.4,
    "file storage": 1.4,
    "san": 1.2,
    "nas": 1.2,
    "vmware": 1.4,
    "virtualization": 1.3,
    "kvm": 0.8,
    "esxi": 0.8,
    "network os": 2.8,
    "network operating system": 2.8,
    "networking": 2.0,
    "routing": 1.4,
    "switching": 1.4,
    "protocols": 1.2,
    "tcp/ip": 1.4,
    "ethernet": 1.2,
    "dns": 0.8,
    "systems engineering": 1.7,
    "system integration": 2.0,
    "solutions engineer": 2.4,
    "solutions engineering": 2.4,
    "solutions": 1.4,
    "consulting engineer": 1.8,
    "customer-facing": 2.0,
    "customer facing": 2.0,
    "customer": 1.0,
    "field": 0.8,
    "technical leader": 1.7,
    "technical leadership": 1.7,
    "leadership": 0.9,
    "agile": 1.0,
    "scrum": 0.8,
    "cross-functional": 1.4,
    "cross functional": 1.4,
    "stakeholder": 1.2,
    "coaching": 1.0,
    "enablement": 0.8,
    "cloud": 1.4,
    "aws": 1.0,
    "azure": 1.0,
    "gcp": 0.8,
}
ENGINEERING_NICE = {
    "requirements": 1.0,
    "risk management": 0.5,
    "fault tolerance": 0.6,
    "resiliency": 0.7,
    "reliability": 1.0,
    "hardware": 0.9,
    "hardware test": 1.3,
    "embedded": 1.0,
    "firmware": 1.0,
    "c++": 0.8,
    "c/c++": 0.8,
    "go": 0.5,
    "simulation": 0.8,
    "modeling": 0.6,
    "matlab": 0.5,
    "simulink": 0.5,
    "mbse": 0.6,
    "sysml": 0.6,
    "digital engineering": 0.7,
    "linux kernel": 0.9,
    "kernel driver": 0.8,
    "cyber": 0.5,
    "security": 0.6,
    "encryption": 0.5,
    "enterprise": 0.7,
    "program management": 0.5,
    "product": 0.5,
}
ENGINEERING_NEG = {
    "intern": -2.0,
    "internship": -2.0,
    "new grad": -1.5,
    "account executive": -2.0,
    "sales development": -2.0,
    "inside account": -1.8,
    "finance": -2.0,
    "accountant": -2.0,
    "legal": -2.0,
    "counsel": -2.0,
    "recruiter": -2.0,
    "asic": -0.8,
    "dft": -1.0,
    "physical design": -1.2,
    "timing constraints": -0.8,
    "photonic": -1.0,
    "photonics": -1.0,
    "rf": -0.5,
    "fpga": -0.6,
    "analog": -0.6,
    "mixed signal": -0.7,
    "semiconductor": -0.6,
    "power electronics": -0.6,
    "mechanical": -0.7,
    "hypersonic": -0.8,
    "missile": -0.7,
    "weapon": -0.7,
    "munitions": -0.6,
    "gnc": -0.5,
    "guidance": -0.4,
    "avionics": -0.4,
    "deterrent": -0.4,
    "war-fighter": -0.3,
}
PROPERTY_CORE = {
    "surveying": 4.0,
    "zoning": 3.5,
    "property": 2.0,
    "permitting": 2.0,
    "land use": 3.0,
}
PROPERTY_NICE = {
    "legal": 1.0,
    "compliance": 1.2,
    "real estate": 1.5,
}
PROPERTY_NEG = {
    "intern": -2.0,
    "sales": -2.5,
}
OLDER_TITLE_BOOST, OLDER_LENGTH_CAP, OLDER_LENGTH_DIVISOR = 1.5, 1.0, 800.0
OLDER_CORE = {
    "solutions": 4.0,
    "python": 2.5,
    "linux": 2.0,
    "unix": 1.0,
    "bash": 1.0,
    "kubernetes": 3.0,
    "openshift": 2.5,
    "docker": 2.0,
    "helm": 1.2,
    "devops": 2.0,
    "sre": 2.0,
    "ci/cd": 1.6,
    "jenkins": 1.0,
    "gitlab": 1.0,
    "github actions": 1.0,
    "observability": 1.3,
    "prometheus": 1.2,
    "grafana": 1.0,
    "terraform": 1.5,
    "infrastructure as code": 1.5,
    "virtualization": 1.2,
    "vmware": 1.2,
    "kvm": 0.8,
    "esxi": 0.8,
    "networking": 1.2,
    "tcp/ip": 1.0,
    "dns": 0.9,
    "testing": 2.0,
    "test automation": 2.2,
    "qa": 2.0,
    "systems engineering": 1.6,
    "system integration": 1.6,
    "cloud": 1.2,
    "aws": 1.0,
    "azure": 1.0,
    "gcp": 0.8,
}
OLDER_NICE = {
    "matlab": 0.8,
    "simulink": 0.8,
    "c++": 0.8,
    "c/c++": 0.8,
    "c ": 0.4,
    "simulation": 1.0,
    "modeling": 0.9,
    "mbse": 0.9,
    "sysml": 0.9,
    "digital engineering": 0.8,
    "linux kernel": 1.0,
    "kernel driver": 0.9,
    "requirements": 0.6,
    "risk management": 0.4,
    "fault tolerance": 0.4,
    "cyber": 0.6,
    "encryption": 0.6,
}
OLDER_NEG = {
    "hypersonic": -0.8,
    "missile": -0.7,
    "weapon": -0.7,
    "munitions": -0.6,
    "gnc": -0.6,
    "guidance": -0.4,
    "navigation": -0.3,
    "avionics": -0.4,
    "deterrent": -0.4,
    "war-fighter": -0.3,
}

PRESETS = {
    DEFAULT_PROFILE: (ENGINEERING_CORE, ENGINEERING_NICE, ENGINEERING_NEG, TITLE_BOOST, LENGTH_CAP, LENGTH_DIVISOR),
    PROPERTY_PROFILE: (PROPERTY_CORE, PROPERTY_NICE, PROPERTY_NEG, TITLE_BOOST, LENGTH_CAP, LENGTH_DIVISOR),
    OLDER_PROFILE: (OLDER_CORE, OLDER_NICE, OLDER_NEG, OLDER_TITLE_BOOST, OLDER_LENGTH_CAP, OLDER_LENGTH_DIVISOR),
}

# Sites offered as examples.
EXAMPLE_SITES = {
    "Cisco": "https://cisco.wd5.myworkdayjobs.com/en-US/Cisco_Careers",
    "NVIDIA": "https://nvidia.wd5.myworkdayjobs.com/NVIDIAExternalCareerSite",
    "Draper": "https://draper.wd5.myworkdayjobs.com/en-US/Draper_Careers",
    "Fidelity": "https://wd1.myworkdaysite.com/en-US/recruiting/fmr/FidelityCareers",
    "Netflix": "https://explore.jobs.netflix.net/careers",
    "Cushman & Wakefield": "https://cw.wd1.myworkdayjobs.com/en-US/External",
    "Dalcour Maclaren": "https://dalcourmaclaren.wd3.myworkdayjobs.com/Dalcour-Maclaren-Careers",
    "Pape-Dawson": "https://papedawson.wd12.myworkdayjobs.com/pde",
    "Old Republic Title": "https://oldrepublic.wd1.myworkdayjobs.com/oldrepublictitle",
}
