"""Row-wise text expressions: cleaning, rules of a closed vocabulary, prompts and parsers. All stay in the JVM.

Lists of words come as Python collections of bounded size (`MOST_WORDS`) and become hash-set tests; larger
lists go through the joins in `corpusloom.operators.rules`.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_WORDS = 20_000

# Fixed values.
STOP_SECTIONS = (
    "See also", "References", "External links", "Notes", "Further reading", "Bibliography", "Sources",
    "Footnotes", "Citations", "Notes and references", "Works cited", "Gallery",
)
MONTHS_DAYS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)
TOPICS = ("history", "people_pre1900", "nature", "earth_places", "science", "myth_religion", "food_tools_crafts", "other")
LIST_TITLES = ("List of", "Index of", "Lists of")
LEAST_CHARS, MOST_CHARS, MOST_NON_ASCII = 3000, 40000, 0.03
LEAST_LINE = 60

#: Maximal runs of word characters, or of others: what a word boundary separates.
WORD_SEGMENTS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
LETTER_SEGMENTS = r"[A-Za-z]+|[^A-Za-z]+"


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def member(name: str, words: Collection[str]) -> str:
    """SQL test of a lambda variable against a bounded set."""
    if len(words) > MOST_WORDS:
        raise ValueError(f"{len(words)} words are too many for an expression; use the joins")
    return f"({name} IN ({', '.join(quoted(w) for w in sorted(words))}))" if words else "false"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def extract(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def clean(text: Column, separator: str = "\n\n") -> Column:
    """Stripped lines up to the first stop section, without blank ones and short ones that end no sentence."""
    lines = F.transform(F.split(text, "\n"), strip)
    stop = F.array_position(F.transform(lines, lambda x: x.isin(*STOP_SECTIONS)), F.lit(True))
    before = F.when(stop > 0, F.slice(lines, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(lines)
    ends = lambda x: x.endswith(".") | x.endswith("!") | x.endswith("?")
    return F.array_join(F.filter(before, lambda x: (x != "") & ((F.length(x) >= LEAST_LINE) | ends(x))), separator)


def non_ascii_ratio(text: Column) -> Column:
    """Share of code points above 127; null for an empty text."""
    return F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.nullif(F.length(text), F.lit(0))


def keep_article(title: Column, text: Column) -> Column:
    listed = title.startswith(LIST_TITLES[0])
    for t in LIST_TITLES[1:]:
        listed = listed | title.startswith(t)
    return ~listed & F.length(text).between(LEAST_CHARS, MOST_CHARS) & (non_ascii_ratio(text) < MOST_NON_ASCII)


def pack_chunks(text: Column, limit: int = 6000, separator: str = "\n\n") -> Column:
    """Paragraphs packed in order: a chunk closes when the next paragraph would take it over the limit; separators don't count."""
    kind = "struct<done: array<string>, now: array<string>, n: bigint>"
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).cast("bigint").alias("n")).cast(kind)

    def step(acc, p):
        n = F.length(p).cast("bigint")
        closes = (F.size(acc["now"]) > 0) & (acc["n"] + n > limit)
        done = F.when(closes, F.array_append(acc["done"], F.array_join(acc["now"], separator))).otherwise(acc["done"])
        now = F.when(closes, F.array(p)).otherwise(F.array_append(acc["now"], p))
        return F.struct(done.alias("done"), now.alias("now"), F.when(closes, n).otherwise(acc["n"] + n).alias("n")).cast(kind)

    last = lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], F.array_join(acc["now"], separator))).otherwise(acc["done"])
    return F.aggregate(F.split(text, separator), zero, step, last)


def _once(allowed: str | None, body: str) -> str:
    """SQL of a body that knows the row's `allowed` array as `_own`. Bound so, its expression is evaluated once a row; a column named inside the body's
    lambdas may be replaced by what defines it, and then it is evaluated for each word."""
    return f"transform(array({allowed}), _own -> {body})[0]" if allowed else body


def _listed(words: Collection[str], names: Collection[str], allowed: str | None) -> str:
    """SQL test of a word w: lower-case words must be in `words`; capitalised ones in `names`, or in the row's `allowed` array column, bound by _once()."""
    name = member("w", names) + (" OR array_contains(_own, w)" if allowed else "")
    return f"CASE WHEN w RLIKE '^[a-z]+$' THEN {member('w', words)} WHEN w RLIKE '^[A-Z][a-z]*$' THEN ({name}) ELSE false END"


def bad_words(text: str, words: Collection[str], names: Collection[str] = (), allowed: str | None = None) -> Column:
    """Words of a text column that are not in the list, in order, with repeats; every pattern but lower-case and capitalised is bad."""
    return F.expr(_once(allowed, f"filter(regexp_extract_all({text}, '[A-Za-z]+', 0), w -> NOT ({_listed(words, names, allowed)}))"))


def check(text: str, words: Collection[str], names: Collection[str] = (), allowed: str | None = None) -> Column:
    """Struct of n_words, bad, oov_rate and bad_punct (characters outside white space, letters, digits and . , ? !)."""
    found = f"transform(array(regexp_extract_all({text}, '[A-Za-z]+', 0)), f -> struct(size(f) AS n, filter(f, w -> NOT ({_listed(words, names, allowed)})) AS bad))"
    rated = f"transform({found}, r -> named_struct('n_words', r.n, 'bad', r.bad, 'oov_rate', size(r.bad) / greatest(r.n, 1)))[0]"
    punct = F.length(F.regexp_replace(F.col(text), r"(?U)[\sA-Za-z0-9.,?!]", ""))
    return F.expr(_once(allowed, rated)).withField("bad_punct", punct)


def normalize(text: str, words: Collection[str], names: Collection[str] = (), allowed: str | None = None) -> Column:
    """Capitalised whole words become lower case where they are no allowed names and their lower case is in the list."""
    name = member("x", names) + (" OR array_contains(_own, x)" if allowed else "")
    low = f"CASE WHEN x RLIKE '^[A-Z][a-z]*$' AND NOT ({name}) AND {member('lower(x)', words)} THEN lower(x) ELSE x END"
    return F.expr(_once(allowed, f"array_join(transform(regexp_extract_all({text}, {quoted(WORD_SEGMENTS)}, 0), x -> {low}), '')"))


def fix_punct(text: Column) -> Column:
    """Only . , ? ! stay, each once and without white space before it; paragraphs are stripped and empty ones go."""
    steps = ((r"[;:]", "."), (r"(?U)[^\sA-Za-z0-9.,?!]", " "), (r"(?U)\s*([.,?!])", "$1"), (r"[ \t]+", " "), (r"([.,?!])\1+", "$1"))
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    parts = F.transform(F.split(text, r"(?U)\n\s*\n"), strip)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def apply_map(text: str, replace: Mapping[str, str], allowed: str | None = None) -> Column:
    """Each maximal run of letters replaced by its entry, in one pass; a row's allowed names stay."""
    if not replace:
        return F.col(text)
    table = "map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in sorted(replace.items())) + ")"
    hit = member("x", replace) + (" AND NOT array_contains(_own, x)" if allowed else "")
    return F.expr(_once(allowed, f"array_join(transform(regexp_extract_all({text}, '{LETTER_SEGMENTS}', 0), x -> CASE WHEN {hit} THEN {table}[x] ELSE x END), '')"))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+", " ")


def drop_bad_sentences(text: str, words: Collection[str], names: Collection[str] = (), allowed: str | None = None, separator: str = "\\n\\n") -> Column:
    """Struct of text, kept and dropped: sentences with a bad word go; blank ones don't count; empty paragraphs vanish."""
    good = f"forall(regexp_extract_all(s, '[A-Za-z]+', 0), w -> {_listed(words, names, allowed)})"
    said = "filter(regexp_extract_all(p, '[^.?!]+[.?!]*', 0), s -> s RLIKE '(?U)\\\\S')"
    # each paragraph's sentences are found and judged once
    parts = f"transform(split({text}, '{separator}'), p -> transform(array({said}), q -> named_struct('n', size(q), 'ok', filter(q, s -> {good})))[0])"
    strip_ = "regexp_replace(s, '(?U)^\\\\s+|\\\\s+$', '')"
    joined = f"array_join(filter(transform(ps, q -> array_join(transform(q.ok, s -> {strip_}), ' ')), p -> p <> ''), '\\n\\n')"
    count = lambda x: f"aggregate(ps, 0, (a, q) -> a + {x})"
    return F.expr(_once(allowed, f"transform(array({parts}), ps -> named_struct('text', {joined}, 'kept', {count('size(q.ok)')}, 'dropped', {count('q.n - size(q.ok)')}))[0]"))


def subject_names(title: str, text: str, words: Collection[str]) -> Column:
    """Capitalised words of a title (brackets removed) that are no list words and almost never in lower case in the text."""
    bounds = lambda x: f"concat('(?<![\\\\p{{L}}\\\\p{{N}}_])', {x}, '(?![\\\\p{{L}}\\\\p{{N}}_])')"
    found = f"regexp_extract_all(regexp_replace({title}, '\\\\(.*?\\\\)', ' '), '[A-Za-z]+', 0)"
    caps = f"array_distinct(filter({found}, w -> w RLIKE '^[A-Z][a-z]+$' AND NOT {member('lower(w)', words)}))"
    few = f"regexp_count({text}, {bounds('lower(w)')}) * 10 <= greatest(regexp_count({text}, {bounds('w')}), 1)"
    return F.expr(f"filter({caps}, w -> {few})")


def user_message(title: Column, subject: Column, text: Column) -> Column:
    return F.concat(F.lit("TITLE: "), title, F.lit("\nSUBJECT NAMES: "), F.coalesce(F.nullif(F.array_join(subject, ", "), F.lit("")), F.lit("(none)")), F.lit("\nTEXT:\n"), text)


def system_prompt(template: str, values: Mapping[str, str]) -> str:
    """Replaces each {key}; driver side."""
    for k, v in values.items():
        template = template.replace("{" + k + "}", v)
    return template


def head_snippet(number: Column, title: Column, text: Column, n: int = 400) -> Column:
    return F.concat(number.cast("string"), F.lit(". "), title, F.lit(" | "), F.translate(F.substring(text, 1, n), "\n", " "))


def repair_list(bad: Column, n: int = 80) -> Column:
    return F.array_join(F.slice(F.array_sort(F.array_distinct(bad)), 1, n), ", ")


def byte_level_display(token: Column) -> Column:
    return F.translate(token, "ĠĊ", "␣⏎")


def chunk_id(article: Column, k: Column) -> Column:
    return F.concat_ws("_", article.cast("string"), k.cast("string"))


def chunk_number(cid: Column) -> Column:
    return F.substring_index(cid, "_", -1).cast("int")


def article_url(article: Column, base: str = "https://en.wikipedia.org/?curid=") -> Column:
    return F.concat(F.lit(base), article.cast("string"))


def length_ratio(new: Column, old: Column) -> Column:
    return F.length(new) / F.nullif(F.length(old), F.lit(0))
