"""Job-posting analytics on Spark: landed pages in, ranked postings out."""
