"""Queries over turns of conversations as notes and paragraphs, and over references between notes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.richtext import RUNS, text_of
from marginalia.operators import edits, mapping, references
from marginalia.sources import docx_sink
from marginalia.sources.docx import read_footnotes
from marginalia.sources.tables import table
from marginalia.workspace import new_folder


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def note_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pieces of a turn stand in it: sentences, some with more spaces, some cut to their first word, as a model would copy them."""
    sentence = lambda s, i: F.when(i % 3 == 0, s).when(i % 3 == 1, F.replace(F.replace(s, F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit("  "))).otherwise(F.split_part(F.trim(s), F.lit(" "), F.lit(1)))
    turns = _turns(spark, sf_dir).select("conv_id", "turn", "text", F.transform(F.split("text", r"\."), sentence).alias("pieces"))
    spans = turns.select("conv_id", "turn", F.posexplode(mapping.forward_spans(F.col("text"), F.col("pieces"))).alias("piece", "span"))
    return spans.select("conv_id", "turn", "piece", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as runs, every other one italic; a placeholder stands behind each third."""
    sentences = F.split("text", r"\.")
    plain = F.transform(sentences, lambda s, i: F.struct(s.alias("text"), (i % 2 == 1).alias("italic"), (i % 3 == 2).alias("gap")))
    hole = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(False).alias("italic")))
    runs = F.flatten(F.transform(plain, lambda r: F.concat(F.array(F.struct(r["text"].alias("text"), r["italic"].alias("italic"))).cast(RUNS), F.when(r["gap"], hole).otherwise(F.array().cast(RUNS)))))
    return _turns(spark, sf_dir).where("text IS NOT NULL").withColumn("runs", runs)


def flattened_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each turn with their offsets."""
    return edits.flattened(_paragraphs(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "run", F.length("text").alias("n_chars"), "italic", "start", "end")


def edited_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight edits of each turn, of which those that don't overlap are made: the new text, a letter for the style of each character, and the edits' new places."""
    p = _paragraphs(spark, sf_dir).withColumn("n", F.length(edits.paragraph_text(F.col("runs"))))

    def edit(k):
        start = ((k * 37 + F.col("conv_id") * 11 + F.col("turn") * 5) % (F.col("n") + 1)).cast("int")
        stop = F.least(F.col("n"), start + (k * 13) % 23 + 1).cast("int")
        return F.struct(start.alias("start"), stop.alias("end"), F.when(k % 3 != 2, F.concat(F.lit("edit"), k.cast("string"))).alias("replacement"), (k % 2 == 0).alias("italic"))

    made = edits.apply_edits(p.withColumn("edits", F.transform(F.sequence(F.lit(0), F.lit(7)), edit)))
    style = F.array_join(F.transform("new_runs", lambda r: F.when(r["text"].isNull(), edits.PLACEHOLDER).otherwise(F.repeat(F.when(r["italic"], "i").otherwise("r"), F.length(r["text"])))), "")
    places = F.array_join(F.transform("made_at", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.select("conv_id", "turn", edits.paragraph_text(F.col("new_runs")).alias("text"), style.alias("style"), places.alias("places"))


def note_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a document, an event a note: purchases and signups cite a source, others refer to a note up to six before, a third of them by name."""
    number = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", number.alias("note"))
    cites = F.col("event_type").isin("purchase", "signup")
    called = F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string"))
    notes = e.select(
        F.col("user_id").alias("doc"),
        "note",
        F.when(cites | (F.col("event_id") % 3 == 0), called).alias("name"),
        F.when(cites, F.concat(called, F.lit(":"), (F.col("event_id") % 4 == 3).cast("int").cast("string"))).alias("source"),
        F.when(~cites, F.col("note") - 1 - (F.col("event_id") % 6)).cast("int").alias("refers_to"),
    )
    return references.resolved(notes)


_XML = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A .docx file of each conversation, its turns as notes."""
    for batch in batches:
        out = []
        for turns in batch.column("turns").to_pylist():
            run = lambda text: "<w:br/>".join(f'<w:t xml:space="preserve">{escape(line)}</w:t>' for line in text.split("\n"))
            notes = "".join(f'<w:footnote w:id="{k + 5}"><w:p><w:r><w:footnoteRef/></w:r><w:r>{run(" " + (t or ""))}</w:r></w:p></w:footnote>' for k, t in enumerate(turns))
            body = "".join(f'<w:p><w:r><w:footnoteReference w:id="{k + 5}"/></w:r></w:p>' for k in range(len(turns)))
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("word/document.xml", f"<w:document {_XML}><w:body>{body}</w:body></w:document>")
                archive.writestr("word/footnotes.xml", f"<w:footnotes {_XML}>{notes}</w:footnotes>")
            out.append(data.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary()), batch.column("notes")], names=["name", "content", "notes"])


def tracked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as .docx files, every other turn changed and written as tracked changes, then read again."""
    turns = _turns(spark, sf_dir).where("text IS NOT NULL")
    numbered = turns.withColumn("note", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text")))
    new = F.replace(F.replace("text", F.lit(" "), F.lit("  ")), F.lit(","), F.lit(" &"))
    change = F.when(F.col("note") % 2 == 0, F.struct("note", F.array(F.struct(new.alias("text"), F.lit(False).alias("italic"))).alias("runs")))
    rows = numbered.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("note", "text"))), lambda t: t["text"]).alias("turns"), F.array_sort(F.collect_list(change)).alias("notes"))
    named = rows.select(F.concat(F.col("conv_id").cast("string"), F.lit(".docx")).alias("name"), "turns", "notes")
    folder = new_folder(spark, "docx")
    docx_sink.register(spark)
    named.mapInArrow(_archives, docx_sink.SCHEMA).write.format("tracked_docx").mode("append").option("path", folder).save()
    read = read_footnotes(spark, folder)
    return read.select(F.regexp_extract("doc", r"([0-9]+)\.docx$", 1).cast("long").alias("conv_id"), "note", text_of(F.col("runs")).alias("text"))


QUERIES = {f.__name__: f for f in (note_spans, flattened_runs, edited_paragraphs, note_references, tracked_notes)}

_SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_HOLE = "￼"
#: Text, style and placeholders of a turn, character by character.
_FLAT = f"""p AS (SELECT conv_id, turn, array_to_string(list_transform(s, lambda x, i: x || CASE WHEN (i - 1) % 3 = 2 THEN '{_HOLE}' ELSE '' END), '') AS text,
  array_to_string(list_transform(s, lambda x, i: repeat(CASE WHEN (i - 1) % 2 = 1 THEN 'i' ELSE 'r' END, length(x)) || CASE WHEN (i - 1) % 3 = 2 THEN '{_HOLE}' ELSE '' END), '') AS style
  FROM (SELECT conv_id, turn, string_split(text, '.') AS s FROM conversations WHERE text IS NOT NULL))"""
ORACLE_SQL = {
    "note_spans": f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS id, conv_id, turn, text, list_transform(string_split(text, '.'), lambda s, i: CASE (i - 1) % 3 WHEN 0 THEN s WHEN 1 THEN replace(replace(s, chr(10), ' '), ' ', '  ') ELSE split_part(trim(s), ' ', 1) END) AS pieces FROM conversations WHERE text IS NOT NULL),
c AS (SELECT id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM t WHERE text <> ''),
f AS (SELECT id, i, CASE WHEN regexp_full_match(c, '{_SPACE}') THEN ' ' ELSE translate(c, '‘’“”', '''''""') END AS c FROM c),
g AS (SELECT * FROM f QUALIFY NOT (c = ' ' AND coalesce(lag(c) OVER (PARTITION BY id ORDER BY i) = ' ', false))),
n AS (SELECT id, string_agg(c, '' ORDER BY i) AS norm, list(i ORDER BY i) AS pos FROM g GROUP BY id),
q AS (SELECT t.id, unnest(range(len(pieces))) AS k, unnest(pieces) AS piece FROM t),
m AS (SELECT id, k, regexp_replace(translate(CASE WHEN contains((SELECT text FROM t WHERE t.id = q.id), '*') THEN piece ELSE replace(piece, '*', '') END, '‘’“”', '''''""'), '{_SPACE}+', ' ', 'g') AS needle FROM q),
s AS (SELECT id, -1::BIGINT AS k, 0::BIGINT AS cursor, NULL::BIGINT AS a, NULL::BIGINT AS b FROM t
  UNION ALL SELECT id, k, CASE WHEN hit > 0 AND needle NOT IN ('', ' ') THEN pos[from_ + hit + length(needle) - 1] + 1 ELSE cursor END, CASE WHEN hit > 0 AND needle NOT IN ('', ' ') THEN pos[from_ + hit] END, CASE WHEN hit > 0 AND needle NOT IN ('', ' ') THEN pos[from_ + hit + length(needle) - 1] + 1 END
  FROM (SELECT s.id, m.k, cursor, needle, pos, from_, instr(substr(norm, (from_ + 1)::BIGINT), needle) AS hit FROM (SELECT s.*, len(list_filter(pos, lambda x: x < cursor)) AS from_, norm, pos FROM s JOIN n USING (id)) s JOIN m ON m.id = s.id AND m.k = s.k + 1))
SELECT conv_id, turn, k::INT AS piece, a::INT AS start, b::INT AS "end" FROM q JOIN t USING (id) LEFT JOIN s USING (id, k)""",
    "flattened_runs": f"""WITH r AS (SELECT conv_id, turn, list_transform(string_split(text, '.'), lambda x, i: {{'x': x, 'i': i - 1}}) AS s FROM conversations WHERE text IS NOT NULL),
x AS (SELECT conv_id, turn, unnest(flatten(list_transform(s, lambda e: CASE WHEN e.i % 3 = 2 THEN [{{'n': length(e.x)::INT, 'italic': e.i % 2 = 1, 'w': length(e.x)::INT}}, {{'n': NULL::INT, 'italic': false, 'w': 1}}] ELSE [{{'n': length(e.x)::INT, 'italic': e.i % 2 = 1, 'w': length(e.x)::INT}}] END))) AS e, unnest(range(len(s) + len(s) // 3))::INT AS run FROM r)
SELECT conv_id, turn, run, e.n AS n_chars, e.italic AS italic, (sum(e.w) OVER w - e.w)::INT AS start, (sum(e.w) OVER w)::INT AS "end" FROM x WINDOW w AS (PARTITION BY conv_id, turn ORDER BY run)""",
    "edited_paragraphs": f"""WITH RECURSIVE {_FLAT},
e0 AS (SELECT conv_id, turn, k, (k * 37 + conv_id * 11 + turn * 5) % (length(text) + 1) AS a, text, style FROM p, range(8) r(k)),
e1 AS (SELECT conv_id, turn, k, a, least(length(text), a + (k * 13) % 23 + 1) AS b, CASE WHEN k % 3 <> 2 THEN 'edit' || k END AS new, CASE WHEN k % 2 = 0 THEN 'i' ELSE 'r' END AS kind, text, style FROM e0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY a DESC, k) AS n FROM e1 WHERE a < b AND NOT contains(substr(text, a + 1, b - a), '{_HOLE}') AND (new IS NOT NULL OR contains(substr(style, a + 1, b - a), CASE kind WHEN 'i' THEN 'r' ELSE 'i' END))),
s AS (SELECT conv_id, turn, text, style, 0::BIGINT AS n, 2147483647::BIGINT AS lim, []::BIGINT[] AS lo, []::BIGINT[] AS hi, []::BIGINT[] AS size FROM p
  UNION ALL SELECT s.conv_id, s.turn, CASE WHEN b <= lim THEN substr(s.text, 1, a) || coalesce(new, substr(s.text, a + 1, b - a)) || substr(s.text, b + 1) ELSE s.text END,
    CASE WHEN b <= lim THEN substr(s.style, 1, a) || CASE WHEN new IS NULL THEN repeat(kind, b - a) ELSE repeat(substr(s.style, a + 1, 1), length(new)) END || substr(s.style, b + 1) ELSE s.style END,
    e.n, CASE WHEN b <= lim THEN a ELSE lim END, CASE WHEN b <= lim THEN list_prepend(a, lo) ELSE lo END, CASE WHEN b <= lim THEN list_prepend(b, hi) ELSE hi END, CASE WHEN b <= lim THEN list_prepend(length(coalesce(new, substr(s.text, a + 1, b - a))), size) ELSE size END
  FROM s JOIN e ON e.conv_id = s.conv_id AND e.turn = s.turn AND e.n = s.n + 1)
SELECT conv_id, turn, text, style, array_to_string(list_transform(range(1, len(lo) + 1), lambda i: (lo[i] + coalesce(list_sum(size[1:i - 1]) - list_sum(list_transform(range(1, i), lambda j: hi[j] - lo[j])), 0))::BIGINT || ':' || (lo[i] + size[i] + coalesce(list_sum(size[1:i - 1]) - list_sum(list_transform(range(1, i), lambda j: hi[j] - lo[j])), 0))::BIGINT), ',') AS places
FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC) = 1""",
    "tracked_notes": "WITH n AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text)::INT AS note FROM conversations WHERE text IS NOT NULL) SELECT conv_id, note, CASE WHEN note % 2 = 0 THEN replace(replace(text, ' ', '  '), ',', ' &') ELSE text END AS text FROM n",
    "note_references": """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS note, event_type IN ('purchase', 'signup') AS cites FROM events),
n AS (SELECT user_id AS doc, note, CASE WHEN cites OR event_id % 3 = 0 THEN 's' || event_id % 5 END AS name, CASE WHEN cites THEN 's' || event_id % 5 || ':' || (event_id % 4 // 3) END AS source, CASE WHEN NOT cites THEN note - 1 - event_id % 6 END AS refers_to FROM e),
w AS (SELECT doc, note, refers_to AS pos, 1::BIGINT AS steps FROM n WHERE source IS NULL UNION ALL SELECT w.doc, w.note, n.refers_to, steps + 1 FROM w JOIN n ON n.doc = w.doc AND n.note = w.pos WHERE n.source IS NULL),
h AS (SELECT w.doc, w.note, s.note AS pos, s.name AS at_name, s.source AS at_source, steps FROM w JOIN n s ON s.doc = w.doc AND s.note = w.pos WHERE s.source IS NOT NULL),
b AS (SELECT r.doc, r.note, min(s.note) AS first, min(s.source) AS low, count(DISTINCT s.source) AS kinds FROM n r JOIN n s ON s.doc = r.doc AND s.name = r.name AND s.note < r.note AND s.source IS NOT NULL WHERE r.source IS NULL GROUP BY ALL),
o AS (SELECT n.*, h.pos, h.at_source, h.steps AS h_steps, b.first, b.low, CASE WHEN n.source IS NOT NULL THEN 'source' WHEN at_source IS NOT NULL AND (n.name IS NULL OR n.name = at_name) THEN 'by number' WHEN kinds = 1 THEN 'by name' ELSE 'unresolved' END AS outcome FROM n LEFT JOIN h USING (doc, note) LEFT JOIN b USING (doc, note))
SELECT doc, note, outcome, CASE outcome WHEN 'source' THEN note WHEN 'by number' THEN pos WHEN 'by name' THEN first END AS root, CASE outcome WHEN 'source' THEN source WHEN 'by number' THEN at_source WHEN 'by name' THEN low END AS source, CASE WHEN outcome = 'by number' THEN h_steps END AS steps FROM o""",
}
