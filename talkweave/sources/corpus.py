"""Corpus sources: directories of md/txt/jsonl files and document tables -> one chunk table.

Every parser is a column expression over one row per document, so a corpus of any size is read
in one narrow pass; only the duplicate-id check shuffles (ids alone, partially aggregated).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.layout import blocked_position
from .files import read_files

SECTION_CUT = r"(?m)(?=^##\s*§\s*\d)"
SECTION_PART = r"\A##\s*§\s*(\d+)\s*[.:-]?\s*([^\n]*)"
HEADING_CUT = r"(?m)(?=^#{2,3}\s)"
HEADING_PART = r"\A#{2,3}\s+([^\n]*)"
TITLE_HEAD = r"(?m)^#\s+(.*)$"

CHUNK_COLUMNS = ["chunk_id", "doc_id", "section", "section_title", "doc_title", "text", "sentences", "status",
                 "superseded_by", "category", "effective_date", "source"]


# ------------------------------------------------------------------ pieces of one document
def front_matter(raw: str) -> Column:
    """map(key -> value) of the leading ``---`` block; the last of equal keys wins."""
    key = T.squeeze_ends_sql("split(l, ':', 2)[0]")
    value = T.squeeze_ends_sql("split(l, ':', 2)[1]")
    unquoted = f"""regexp_replace(regexp_replace({value}, r'^\\x22+|\\x22+$', ''), r"^'+|'+$", '')"""
    lines = f"filter(split(regexp_extract({raw}, r'(?s)\\A---(.*?)\\n---', 1), r'\\R'), l -> contains(l, ':'))"
    entries = f"transform({lines}, l -> named_struct('k', {key}, 'v', {unquoted}))"
    last = "filter(e, (x, i) -> NOT exists(slice(e, i + 2, size(e)), y -> y.k = x.k))"
    return F.expr(f"map_from_entries(flatten(transform(array({entries}), e -> {last})))")


def body_of(raw: str) -> Column:
    return F.expr(f"regexp_replace({raw}, r'(?s)\\A---.*?\\n---', '')")


def sections(body: str, window_words: int) -> Column:
    """array<struct<section, section_title, text>>: ``## §N`` sections, else headings, else windows."""
    def cut(at: str, head: str, number: str, title_group: int) -> str:
        # text before the first heading belongs to no section
        parts = f"filter(split({body}, {T.raw_string(at)}), p -> p RLIKE {T.raw_string(head)})"
        title = T.squeeze_ends_sql(f"regexp_extract(p, {T.raw_string(head)}, {title_group})")
        text = T.squeeze_ends_sql(f"regexp_replace(p, {T.raw_string(head)}, '')")
        return f"transform({parts}, (p, i) -> named_struct('section', {number}, 'section_title', {title}, 'text', {text}))"

    numbered = cut(SECTION_CUT, SECTION_PART, f"regexp_extract(p, {T.raw_string(SECTION_PART)}, 1)", 2)
    headed = cut(HEADING_CUT, HEADING_PART, "CAST(i + 1 AS STRING)", 1)
    windowed = (f"transform({T.windows_sql(body, window_words)}, w -> named_struct('section', CAST(w.section AS STRING), "
                f"'section_title', w.section_title, 'text', w.text))")
    return F.expr(f"CASE WHEN {body} RLIKE {T.raw_string(SECTION_CUT)} THEN {numbered} "
                  f"WHEN {body} RLIKE {T.raw_string(HEADING_CUT)} THEN {headed} ELSE {windowed} END")


def doc_id_of_stem(stem_col: Column) -> Column:
    numbered = F.regexp_extract(stem_col, r"^(Doc_\d+)", 1)
    return F.when(numbered != "", numbered).otherwise(
        F.substring(F.regexp_replace(stem_col, r"[^A-Za-z0-9_]+", "_"), 1, 40))


# ------------------------------------------------------------------ chunk tables
def markdown_chunks(docs: DataFrame, window_words: int = 180) -> DataFrame:
    """``docs(path, raw)`` -> chunk table."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem_col = F.regexp_replace(name, r"\.[^.]*$", "")
    base = docs.select(name.alias("source"), stem_col.alias("stem"), front_matter("raw").alias("meta"),
                       body_of("raw").alias("body"))

    def meta(key: str) -> Column:
        value = F.try_element_at("meta", F.lit(key))
        return value

    title_head = T.squeeze_ends(f"regexp_extract(body, {T.raw_string(TITLE_HEAD)}, 1)")
    filled = base.select(
        "source",
        F.coalesce(F.nullif(meta("doc_id"), F.lit("")), doc_id_of_stem(F.col("stem"))).alias("doc_id"),
        F.coalesce(F.nullif(meta("title"), F.lit("")),
                   F.when(F.col("body").rlike(TITLE_HEAD), title_head), F.col("stem")).alias("doc_title"),
        F.coalesce(meta("status"), F.lit("current")).alias("status"),
        meta("superseded_by").alias("superseded_by"), meta("category").alias("category"),
        meta("effective_date").alias("effective_date"),
        F.regexp_replace("body", r"(?s)\A(.*?)(?m)^#\s+[^\n]*$", "$1").alias("body"))
    exploded = filled.select("*", F.explode(sections("body", window_words)).alias("s")).drop("body")
    return _finish(exploded.select("*", "s.section", "s.section_title", "s.text").drop("s")
                   .filter(F.col("text") != ""))


def read_directory(spark: SparkSession, path: str, window_words: int = 180) -> DataFrame:
    """Chunks of all markdown, text and jsonl files below a folder; dotfiles and ``readme.md`` are no corpus files."""
    docs = read_files(spark, path, "md", "markdown", "txt", whole=True).select("path", "raw")
    return reject_duplicate_ids(markdown_chunks(docs, window_words).unionByName(jsonl_chunks(read_files(spark, path, "jsonl"))))


JSONL_SCHEMA = ("doc_id string, id string, title string, text string, section string, section_title string, "
                "status string, superseded_by string, category string, effective_date string")


def jsonl_chunks(lines: DataFrame, block: int = 1 << 22) -> DataFrame:
    """``lines(path, offset, raw)`` -> chunk table; a record without section takes its number among its document's records in the file.

    The number follows the offsets: counted within stretches of ``block`` bytes of a file, then shifted by the stretches
    before, so a document may fill files of any size and no task holds more than one stretch.  A line that is not a JSON object
    with a ``doc_id`` or ``id`` fails the job.  An empty ``doc_id`` or ``section`` counts as absent; blank lines count nothing.
    """
    rec = lines.filter(F.trim("raw") != "").select("path", "offset", F.from_json("raw", JSONL_SCHEMA).alias("r")).select("path", "offset", "r.*")
    present = lambda c: F.nullif(F.col(c), F.lit(""))
    rec = rec.withColumn("doc_id", F.coalesce(present("doc_id"), present("id"), F.raise_error(
        F.concat(F.lit("no JSON record with doc_id or id: line at byte "), "offset", F.lit(" of "), "path")))).drop("id")
    rec = rec.withColumn("_document", F.struct("path", "doc_id"))
    numbered = blocked_position(rec, "_document", "offset", "k", block=block)
    return _finish(numbered.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "doc_id",
        F.coalesce(present("section"), F.col("k").cast("string")).alias("section"),
        F.coalesce("section_title", F.lit("")).alias("section_title"),
        F.coalesce("title", "doc_id").alias("doc_title"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("status", F.lit("current")).alias("status"), "superseded_by", "category", "effective_date"))


def _finish(df: DataFrame) -> DataFrame:
    return df.select(
        F.concat("doc_id", F.lit("§"), "section").alias("chunk_id"), "doc_id", "section", "section_title", "doc_title",
        "text", T.sentence_units("text").alias("sentences"), "status", "superseded_by", "category", "effective_date",
        "source")


def table_chunks(documents: DataFrame, labels: DataFrame | None = None, window_words: int = 180) -> DataFrame:
    """``documents(doc_id, text, source)`` as plain-text documents: windows titled ``Part k``.

    With ``labels`` a document of quality 0 counts as superseded by the next document id.
    """
    d = documents.select(F.col("doc_id").alias("_id"), F.col("source"), "text")
    if labels is not None:
        d = d.join(labels.select(F.col("doc_id").alias("_id"), "quality"), "_id", "left")
    else:
        d = d.withColumn("quality", F.lit(1))
    old = F.col("quality") == 0
    base = d.select(
        F.col("_id").cast("string").alias("doc_id"), F.col("_id").cast("string").alias("doc_title"),
        F.when(old, "superseded").otherwise("current").alias("status"),
        F.when(old, (F.col("_id") + 1).cast("string")).alias("superseded_by"),
        F.col("source").alias("category"), F.lit(None).cast("string").alias("effective_date"), "source",
        F.explode_outer(T.windows("text", window_words)).alias("w")).filter(F.col("w").isNotNull())      # inner: the texts would be cut twice
    return _finish(base.select("*", F.col("w.section").cast("string").alias("section"), "w.section_title", "w.text")
                   .drop("w"))


def reject_duplicate_ids(chunks: DataFrame) -> DataFrame:
    """Fails the job when a chunk id occurs twice (ids are counted, texts are not moved)."""
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("source").alias("s")).filter("n > 1").limit(1)
    bad = twice.first()
    if bad:
        raise ValueError(f"duplicate chunk id {bad['chunk_id']} ({bad['s']})")
    return chunks


# ------------------------------------------------------------------ derived columns
def label(doc_id="doc_id", section="section") -> Column:
    return F.concat(T._c(doc_id), F.lit(" §"), T._c(section))


SHORT_TITLE = T.squeeze_ends_sql(r"split(doc_title, r'\s+-\s+|:\s+')[0]")
INDEX_TEXT = "concat_ws('. ', doc_title, section_title, text)"
SENTENCE_INDEX_TEXT = f"concat({SHORT_TITLE}, ' - ', section_title, ': ', sentence)"


# ------------------------------------------------------------------ reports
def doc_rollup(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(
        F.first("doc_title").alias("title"), F.first("status").alias("status"),
        F.count("*").alias("sections"), F.sum(F.size("sentences")).alias("units"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    n = F.size(T.words("text"))
    per_doc = chunks.groupBy("doc_id").agg(
        F.count("*").alias("c"), F.sum(F.size("sentences")).alias("u"), F.min(n).alias("lo"),
        F.max(n).alias("hi"), F.sum(n).alias("w"))
    return per_doc.agg(
        F.count("*").alias("documents"), F.sum("c").alias("chunks"), F.sum("u").alias("units"),
        F.min("lo").cast("long").alias("min_words"), F.max("hi").cast("long").alias("max_words"),
        F.round(F.sum("w") / F.sum("c"), 6).alias("mean_words"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest over ``files(path, content)`` that depends on names and bytes, not on order.

    Per-file digests are folded with xor in the partial aggregation, so no list is gathered.
    """
    d = F.sha2(F.concat(F.encode(F.regexp_extract("path", r"([^/]+)$", 1), "UTF-8"), F.col("content")), 256)
    parts = [F.bit_xor(F.conv(F.substring(d, 1 + 15 * i, 15), 16, 10).cast("long")) for i in range(2)]
    return files.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)], F.count("*").alias("n_files")).select(
        F.substring(F.sha2(F.concat_ws("/", "p0", "p1", "n_files"), 256), 1, 16).alias("fingerprint"), "n_files")


def validation_errors(chunks: DataFrame, required=("doc_title", "category", "effective_date", "status"),
                      min_sections: int = 3) -> DataFrame:
    """Corpus rules: required metadata present, sections numbered 1..n, ASCII text, at least three sections."""
    n = F.col("section").cast("int")
    d = chunks.groupBy("doc_id").agg(
        *[F.max(F.col(c).isNull() | (F.col(c) == "")).alias(f"no_{c}") for c in required],
        F.count("*").alias("cnt"), F.count_distinct("section").alias("uniq"), F.min(n).alias("lo"),
        F.max(n).alias("hi"),
        F.max(F.regexp_replace(F.concat_ws("\n", "doc_title", "section_title", "text"), "§", "")
              .rlike(r"[^\x00-\x7F]")).alias("non_ascii"))
    sequential = (F.col("lo") == 1) & (F.col("hi") == F.col("cnt")) & (F.col("uniq") == F.col("cnt"))
    rules = [F.when(F.col(f"no_{c}"), F.lit(f"missing {c}")) for c in required]
    rules.append(F.when(~(sequential & (F.col("cnt") >= min_sections)), F.lit("sections not sequential")))
    rules.append(F.when(F.col("non_ascii"), F.lit("non-ASCII characters")))
    return d.select("doc_id", F.explode(F.array_compact(F.array(*rules))).alias("error"))
