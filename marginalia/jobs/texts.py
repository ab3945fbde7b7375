"""Queries over documents, pages and the benchmark: keys, tokens, fingerprints, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as t
from marginalia.functions.dialect import DUCK, SPARK, Spark, with_steps
from marginalia.operators import fingerprints as fp
from marginalia.operators import grounding, names
from marginalia.sources.tables import table


def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.norm_key(F.col("text")), 256).alias("key_sha256"))


def clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", t.clean_field(F.col("line")).alias("field"))


def _with(rows: DataFrame, *steps: dict[str, str]) -> DataFrame:
    for step in steps:
        rows = rows.withColumns({name: F.expr(rule) for name, rule in step.items()})
    return rows


def meaningful_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct meaningful words of each document, in order."""
    rows = _with(table(spark, sf_dir, "documents"), {"m": SPARK.let(grounding.words(SPARK, "text"), lambda w: grounding.meaningful(SPARK, w), "of_text")})
    return rows.select("doc_id", F.size("m").alias("n"), F.array_join("m", " ").alias("words"))


def token_coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meaningful words of a document that its first two lines don't have, and how many numbers of these it doesn't have (none)."""
    # Dealt anew, since a file can come as one piece, which one task would read and compare.
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").hint("rebalance")
    rows = texts.select("doc_id", "text", F.substring_index("text", "\n", 2).alias("kept"))
    out = _with(rows, {"missing": grounding.missing(SPARK, "text", "kept"), "invented": grounding.invented(SPARK, "text", "kept")})
    return out.select("doc_id", F.size("missing").alias("n_missing"), F.array_join("missing", " ").alias("missing"), F.size("invented").alias("n_invented"))


def number_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a page's address that its markup doesn't have."""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(SPARK.join(grounding.invented(SPARK, "html", "url"), ",")).alias("ungrounded"))


#: Rows of a task that finds different pairs.
_PAIRS_OF_A_TASK = 500_000


def _span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different pairs of unequal numbers, found as numbers and in more tasks where there are more rows, so that a task holds the same at any size."""
    lines = table(spark, sf_dir, "lineitem").select(F.least("l_orderkey", "l_partkey").alias("a"), F.greatest("l_orderkey", "l_partkey").alias("b")).where("a <> b")
    # Counted from the footers of the files.
    tasks = table(spark, sf_dir, "lineitem").count() // _PAIRS_OF_A_TASK + 1
    return lines.repartition(tasks, "a", "b").distinct().select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


_CITED = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' v The Queen' WHEN 1 THEN upper(substr(p_name, 1, 5)) || ' v ' || p_type WHEN 2 THEN 'Re ' || p_name || '; Ex parte Aust Bros (No 2)' WHEN 3 THEN 'ACCC v ' || p_name ELSE 'R v R' END"
_TITLED = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' v ' || p_type WHEN 1 THEN 'Australian Competition & Consumer Commission v ' || p_name || ' Pty Ltd [No 3]' WHEN 2 THEN p_type || ' and Australia Brothers' ELSE 'State of ' || p_brand END"


def _alike(d: Spark) -> list[dict[str, str]]:
    (cited, cited_more), (title, title_more) = names.reading(d, "cited", "c"), names.reading(d, "title", "t")
    return [cited | title | {"mine": names.telling(d, "cited"), "theirs": names.telling(d, "title")}, cited_more | title_more, {"same_case": names.shares_word(d, "mine", "theirs"), "plausible": names.names_each_side(d, "c", "t")}]


def case_names_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited names of cases against titles: could they be one case, and is every party named."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CITED).alias("cited"), F.expr(_TITLED).alias("title"))
    for step in _alike(SPARK):
        rows = rows.withColumns({c: F.expr(x) for c, x in step.items()})
    return rows.select("p_partkey", "same_case", "plausible")


def span_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_pairs(spark, sf_dir).select("a", "b", t.shorten_span(F.col("a"), F.col("b")).alias("span"))


def span_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Different pairs have different spans: the first number stands whole, and a second one is shortened only by digits that the first has too.
    pairs = _span_pairs(spark, sf_dir).select(t.shorten_span(F.col("a"), F.col("b")).alias("span"))
    first, last = t.expand_span(F.col("span"))
    return pairs.select("span", first.alias("first"), last.alias("last"))


def html_to_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = t.html_plain(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).alias("n_chars"), F.sha2(plain, 256).alias("plain_sha256"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.html_escape(F.col("text")), 256).alias("escaped_sha256"))


def doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.document_fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.ranked_lines(fp.line_hashes(table(spark, sf_dir, "documents"), "doc_id", "text"))


def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later documents that have five lines and 60 percent of their lines in common with an earlier one."""
    return fp.containment(_ranked(spark, sf_dir), share=0.6).drop("earlier_total")


def seen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the earlier document that has most of its lines (five at least; ties to the latest), and the share."""
    return fp.best_earlier(_ranked(spark, sf_dir)).select("new", "earlier", "shared", F.round(F.col("shared") / F.col("new_total"), 6).alias("share"))


def revision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions: half of the new lines are old, half of the old lines are met, and new ones are at most half the old."""
    pairs = fp.containment(_ranked(spark, sf_dir), share=0.5)
    old = F.col("shared") >= 0.5 * F.col("earlier_total")
    return pairs.where(old & (F.col("new_total") - F.col("shared") <= 0.5 * F.col("earlier_total"))).select("new", "earlier", "shared")


def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every sentence of a benchmark item; sentences are met by equality, not by pairs of texts."""
    items = _sentences(table(spark, sf_dir, "benchmark"), "item_id")
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    docs = _sentences(table(spark, sf_dir, "documents"), "doc_id")
    found = docs.join(items, "form").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_found"))
    return found.join(sizes, "item_id").where("n_found = n").select("doc_id", "item_id", "n_found")


def _sentences(rows: DataFrame, key: str) -> DataFrame:
    parts = F.explode(F.split("text", r"[.!?\n]+"))
    return rows.select(key, parts.alias("part")).select(key, t.fingerprint_form(F.col("part")).alias("form")).where(F.length("form") >= 12).distinct()


def missing_fullstop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where((F.length(F.trim("line")) > 0) & ~F.col("line").rlike(r"[.!?]$")).select("doc_id", "pos")


def warning_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first kind that fits each document, counted."""
    kind = F.when(F.col("text").isNull() | (F.length("text") < 100), "short").when(F.col("text").contains("Licen"), "license").when(F.col("text").rlike("[#*$%&|]{3}"), "signs").when(F.col("text").rlike("[0-9]{6}"), "numbers").otherwise("other")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def reextraction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a second run (labels) take the place of the first's; what was not run again stays."""
    first = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("run"), F.lit(None).cast("int").alias("quality"))
    again = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("run"), "quality")
    kept = first.join(again, "doc_id", "left_anti").unionByName(again)
    return kept.select("doc_id", "run", "quality")


def longest_prefix_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest section of a page: the longest known prefix of its path among the sections that many pages have."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.filter(F.split(path, "/"), lambda s: s != "").alias("parts"))
    prefixes = pages.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1))), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("prefix"))
    known = prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("prefix")
    hits = prefixes.join(known, "prefix").groupBy("page_id").agg(F.max_by("prefix", F.length("prefix")).alias("section"))
    return pages.select("page_id").join(hits, "page_id", "left")


def word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrence number of each line form of a document and whether it repeats the line before."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = W.partitionBy("doc_id").orderBy("pos")
    key = F.sha2(t.fingerprint_form(F.col("line")), 256)
    keyed = lines.select("doc_id", "pos", key.alias("key"))
    return keyed.select("doc_id", "pos", F.row_number().over(W.partitionBy("doc_id", "key").orderBy("pos")).alias("occurrence"), F.coalesce(F.lag("key").over(w) == F.col("key"), F.lit(False)).alias("repeats"))


_S = r"[ \t\n\r\x0B\x0C]"
_FORM = "trim(regexp_replace(regexp_replace(lower(translate({x}, '‘’‚‛“”„‟–—−‐‑', '''''''''\"\"\"\"-----')), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\x0B\\x0C]', '', 'g'), '" + _S + "+', ' ', 'g'))"
_COUNTABLE = "length(form) >= 12 AND NOT regexp_matches(form, '^ibid( [0-9]+)?$') AND NOT regexp_matches(form, '^(above|supra) n [0-9]+$')"
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"
_HASHES = f"forms AS (SELECT doc_id AS doc, {_FORM.format(x='line')} AS form FROM ({_LINES})), hashes AS (SELECT DISTINCT doc, substr(sha256(form), 1, 32) AS hash FROM forms WHERE {_COUNTABLE})"
_PAIRS = "totals AS (SELECT doc, count(*) AS total FROM hashes GROUP BY doc), pairs AS (SELECT a.doc AS new, b.doc AS earlier, count(*) AS shared, any_value(t.total) AS new_total FROM hashes a JOIN hashes b ON a.hash = b.hash AND a.doc > b.doc JOIN totals t ON t.doc = a.doc GROUP BY ALL HAVING count(*) >= 5)"


def _chained(start: str, *steps: dict[str, str]) -> tuple[str, str]:
    """WITH clauses that add the columns of each step, and the name of the last."""
    out = f"WITH g0 AS ({start})"
    for i, step in enumerate(steps):
        out += f", g{i + 1} AS (SELECT *, {', '.join(f'{rule} AS {name}' for name, rule in step.items())} FROM g{i})"
    return out, f"g{len(steps)}"


def _selected(start: str, steps: list[dict[str, str]], columns: str) -> str:
    with_, last = _chained(start, *steps)
    return f"{with_} SELECT {columns} FROM {last}"


_g = grounding
_SQL_MEANINGFUL_TOKENS = _selected("SELECT doc_id, text FROM documents", [{"m": DUCK.let(_g.words(DUCK, "text"), lambda w: _g.meaningful(DUCK, w), "of_text")}], "doc_id, len(m)::INT AS n, array_to_string(m, ' ') AS words")
# By rows of words, since lists that a lambda holds are copied for each element here.
_SQL_TOKEN_COVERAGE_GAP = f"""WITH x AS (SELECT doc_id, text, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS kept FROM documents),
l AS (SELECT doc_id, text, kept, {_g.words(DUCK, 'text')} AS ws, {_g.words(DUCK, 'kept')} AS ms FROM x),
o AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM l), m AS (SELECT doc_id, unnest(ms) AS w, unnest(range(len(ms))) AS pos FROM l),
oo AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM o), mm AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM m),
n AS (SELECT doc_id, {_g.bare(DUCK, 'w')} AS h FROM m WHERE {_g.is_number(DUCK, 'w')} UNION SELECT doc_id, unnest({_g.span_ends(DUCK, 'kept')}) FROM l),
own AS (SELECT doc_id, {_g.bare(DUCK, 'w')} AS h FROM o WHERE {_g.is_number(DUCK, 'w')} UNION SELECT doc_id, unnest({_g.span_ends(DUCK, 'text')}) FROM l),
held AS (SELECT doc_id, w AS h FROM m WHERE {_g.tells(DUCK, 'w')} UNION SELECT * FROM n UNION SELECT doc_id, w || b FROM mm WHERE b IS NOT NULL),
as_one AS (SELECT oo.doc_id, w, b FROM oo JOIN held ON oo.doc_id = held.doc_id AND oo.w || oo.b = held.h), halves AS (SELECT doc_id, w FROM as_one UNION SELECT doc_id, b FROM as_one),
asked AS (SELECT doc_id, w, min(pos) AS pos, CASE WHEN {_g.is_number(DUCK, 'w')} THEN {_g.bare(DUCK, 'w')} ELSE w END AS plain FROM o WHERE {_g.tells(DUCK, 'w')} GROUP BY doc_id, w),
gone AS (SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = a.doc_id AND h.h = a.w) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = a.doc_id AND h.h = a.plain) AND NOT EXISTS (SELECT 1 FROM halves h WHERE h.doc_id = a.doc_id AND h.w = a.w)),
g AS (SELECT doc_id, count(*)::INT AS n, string_agg(w, ' ' ORDER BY pos) AS ws FROM gone GROUP BY doc_id), i AS (SELECT doc_id, count(*)::INT AS n FROM (SELECT * FROM n EXCEPT SELECT * FROM own) GROUP BY doc_id)
SELECT x.doc_id, coalesce(g.n, 0) AS n_missing, coalesce(g.ws, '') AS missing, coalesce(i.n, 0) AS n_invented FROM x LEFT JOIN g USING (doc_id) LEFT JOIN i USING (doc_id)"""
_SQL_NUMBER_GROUNDING = _selected("SELECT page_id, url, html FROM pages", [{"x": _g.invented_by_words(DUCK, "html", "url")}], "page_id, array_to_string(x, ',') AS ungrounded")
_SHORT = """CASE WHEN length(a) = length(b) AND a < b THEN substr(b, CASE WHEN length(b) >= 2 AND substr(b, length(b) - 1, 1) = '1' THEN least(d, length(b) - 1) ELSE d END) ELSE b END"""
_SPANS = f"""WITH p AS (SELECT DISTINCT least(l_orderkey, l_partkey)::VARCHAR AS a, greatest(l_orderkey, l_partkey)::VARCHAR AS b FROM lineitem),
q AS (SELECT a, b, list_position(list_transform(range(1, length(b) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)), true) AS d FROM p WHERE a <> b),
s AS (SELECT a, b, a || '–' || {_SHORT} AS span FROM q)"""

QUERIES = {
    "norm_key": norm_keys,
    "clean_field": clean_fields,
    "meaningful_tokens": meaningful_tokens,
    "token_coverage_gap": token_coverage_gap,
    "number_grounding": number_grounding,
    "case_names_alike": case_names_alike,
    "span_shorten": span_shorten,
    "span_expand": span_expand,
    "html_to_plain": html_to_plain,
    "html_escape": html_escape,
    "doc_fingerprints": doc_fingerprints,
    "containment_pairs": containment_pairs,
    "seen_candidates": seen_candidates,
    "revision_pairs": revision_pairs,
    "benchmark_containment": benchmark_containment,
    "missing_fullstop": missing_fullstop,
    "warning_histogram": warning_histogram,
    "reextraction_merge": reextraction_merge,
    "longest_prefix_section": longest_prefix_section,
    "word_repeats": word_repeats,
}
ORACLE_SQL = {
    "norm_key": f"SELECT doc_id, sha256(regexp_replace(lower(coalesce(text, '')), '[.,''’‘]|{_S}', '', 'g')) AS key_sha256 FROM documents",
    "clean_field": f"SELECT doc_id, pos::INT AS pos, nullif(regexp_replace(trim(regexp_replace(line, '{_S}+', ' ', 'g')), '[ .,;:]+$', ''), '') AS field FROM ({_LINES})",
    "meaningful_tokens": _SQL_MEANINGFUL_TOKENS,
    "token_coverage_gap": _SQL_TOKEN_COVERAGE_GAP,
    "number_grounding": _SQL_NUMBER_GROUNDING,
    "case_names_alike": f"WITH {with_steps('a', f'SELECT p_partkey, {_CITED} AS cited, {_TITLED} AS title FROM part', _alike(DUCK))} SELECT p_partkey, same_case, plausible FROM a",
    "span_shorten": f"{_SPANS} SELECT a, b, span FROM s",
    "span_expand": f"{_SPANS} SELECT DISTINCT span, a AS first, CASE WHEN length(split_part(span, '–', 2)) < length(a) THEN substr(a, 1, length(a) - length(split_part(span, '–', 2))) ELSE '' END || split_part(span, '–', 2) AS last FROM s",
    "html_to_plain": "WITH p AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS plain FROM pages) SELECT page_id, length(plain)::INT AS n_chars, sha256(plain) AS plain_sha256 FROM p",
    "html_escape": "SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_sha256 FROM documents",
    "doc_fingerprints": f"WITH f AS (SELECT doc_id AS doc, pos, {_FORM.format(x='line')} AS form FROM ({_LINES})) SELECT doc, sha256(string_agg(form, chr(10) ORDER BY pos)) AS doc_hash, (count(DISTINCT form) FILTER ({_COUNTABLE}))::INT AS n_hashes FROM f GROUP BY doc",
    "containment_pairs": f"WITH {_HASHES}, {_PAIRS} SELECT new, earlier, shared::INT AS shared, new_total::INT AS new_total FROM pairs WHERE shared >= ceil(new_total * 0.6::DOUBLE)",
    "seen_candidates": f"WITH {_HASHES}, {_PAIRS} SELECT new, earlier, shared::INT AS shared, round(shared / new_total, 6) AS share FROM pairs QUALIFY row_number() OVER (PARTITION BY new ORDER BY shared DESC, earlier DESC) = 1",
    "revision_pairs": f"WITH {_HASHES}, {_PAIRS} SELECT new, earlier, shared::INT AS shared FROM pairs JOIN totals e ON e.doc = earlier WHERE shared >= ceil(new_total * 0.5) AND shared >= 0.5 * e.total AND new_total - shared <= 0.5 * e.total",
    "benchmark_containment": f"""WITH i AS (SELECT DISTINCT item_id, form FROM (SELECT item_id, {_FORM.format(x='part')} AS form FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS part FROM benchmark)) WHERE length(form) >= 12),
d AS (SELECT DISTINCT doc_id, form FROM (SELECT doc_id, {_FORM.format(x='part')} AS form FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS part FROM documents)) WHERE length(form) >= 12),
s AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN i USING (form) JOIN s USING (item_id) GROUP BY doc_id, item_id HAVING count(*) = any_value(n)""",
    "missing_fullstop": f"SELECT doc_id, pos::INT AS pos FROM ({_LINES}) WHERE length(trim(line)) > 0 AND NOT regexp_matches(line, '[.!?]$')",
    "warning_histogram": "SELECT CASE WHEN text IS NULL OR length(text) < 100 THEN 'short' WHEN contains(text, 'Licen') THEN 'license' WHEN regexp_matches(text, '[#*$%&|]{3}') THEN 'signs' WHEN regexp_matches(text, '[0-9]{6}') THEN 'numbers' ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY 1",
    "reextraction_merge": "SELECT doc_id, 0::INT AS run, NULL::INT AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 1::INT, quality FROM labels",
    "longest_prefix_section": """WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/'), lambda s: s <> '') AS parts FROM pages),
x AS (SELECT page_id, unnest(list_transform(range(1, greatest(len(parts), 1) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS prefix FROM p),
k AS (SELECT prefix FROM x GROUP BY prefix HAVING count(*) >= 5),
h AS (SELECT page_id, arg_max(prefix, length(prefix)) AS section FROM x JOIN k USING (prefix) GROUP BY page_id)
SELECT page_id, section FROM p LEFT JOIN h USING (page_id)""",
    "word_repeats": f"WITH k AS (SELECT doc_id, pos, sha256({_FORM.format(x='line')}) AS key FROM ({_LINES})) SELECT doc_id, pos::INT AS pos, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos)::INT AS occurrence, coalesce(lag(key) OVER (PARTITION BY doc_id ORDER BY pos) = key, false) AS repeats FROM k",
}
