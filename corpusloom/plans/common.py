"""SQL fragments that several oracles share."""

WORDS = "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents"
COUNTS = f"SELECT w, count(*) AS n FROM ({WORDS}) GROUP BY w"
#: The closed list of the rule queries: lower-case words among the LISTED most frequent.
LISTED = 300
LIST = f"SELECT w FROM (SELECT w, n FROM ({COUNTS}) ORDER BY n DESC, w LIMIT {LISTED}) WHERE regexp_full_match(w, '[a-z]+')"
SEGMENTS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"
#: Budgets in bytes of the split queries.
HELD, TRAIN = 200_000, 1_000_000
ORDERED = "SELECT *, md5('0:' || doc_id) AS o, strlen(text) AS b FROM documents"
BEFORE = f"SELECT *, coalesce(sum(b) OVER (ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({ORDERED})"
SPLIT = f"""SELECT *, CASE WHEN before < {HELD} THEN 'held' WHEN before - (SELECT coalesce(max(before + b), 0) FROM ({BEFORE}) WHERE before < {HELD}) < {TRAIN} THEN 'train' ELSE 'dropped' END AS split
FROM ({BEFORE})"""
