"""Question-answering datasets to documents and questions.  Network downloads are left to the caller: ``path`` holds the raw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t

# The columns that can hold each field, in order of preference.
TEXT_KEYS = ["text", "content", "body", "article", "passage", "document", "news", "article_text"]
TITLE_KEYS = ["title", "headline", "name"]
QUERY_KEYS = ["query", "question"]
ANSWER_KEYS = ["answer", "gold_answer", "ground_truth", "ground_truth_answer"]
EVIDENCE_KEYS = ["evidence", "supporting_evidence", "support", "supporting_facts", "evidence_list"]
ID_KEYS = ["id", "doc_id", "document_id", "url"]
QA_NAMES, DOCUMENT_NAMES = ["query", "question", "qa", "answer"], ["corpus", "document", "article", "news"]
MIN_CHARS = 30
EVIDENCE = "array<struct<url:string,title:string>>"


#: Where a row stands in its file, in a column of this name if there is one.
PLACE = "_place"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSONL, JSON, CSV or TSV file with their PLACE; of a JSON object with a list under data, documents, queries, qa or items that list."""
    lowered = path.lower()
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    placed = F.struct(*block, F.monotonically_increasing_id().alias("row"), F.lit(0).alias("item")).alias(PLACE)
    if lowered.endswith((".csv", ".tsv")):
        return spark.read.csv(path, header=True, sep="\t" if lowered.endswith(".tsv") else ",", multiLine=True, escape='"').select("*", placed)
    if lowered.endswith(".jsonl"):
        return spark.read.json(path).select("*", placed)
    df = spark.read.json(path, multiLine=True)
    for key in ("data", "documents", "queries", "qa", "items"):
        if key in df.columns and df.schema[key].dataType.typeName() == "array":
            listed = df.select(placed, F.posexplode(key).alias("_n", "_r"))
            return listed.select("_r.*", F.col(PLACE).withField("item", F.col("_n")).alias(PLACE))
    return df.select("*", placed)


def place_of(df: DataFrame) -> list[Column]:
    return [F.col(PLACE)] if PLACE in df.columns else []


def guess_kind(name: str, columns: list[str]) -> str:
    """qa or documents, by the file's name, else by its columns."""
    name = name.lower()
    for kind, parts in (("qa", QA_NAMES), ("documents", DOCUMENT_NAMES)):
        if any(p in name for p in parts):
            return kind
    own = {c.lower() for c in columns}
    return "qa" if own & set(QUERY_KEYS) and own & set(ANSWER_KEYS) else "documents"


def first_of(df: DataFrame, keys: list[str]) -> Column:
    """The first of the columns ``keys`` (any case) that is neither null nor empty."""
    own = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.col(own[k]).cast("string"), F.lit("")) for k in keys if k in own and df.schema[own[k]].dataType.typeName() not in ("array", "struct", "map")]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def normalize_documents(df: DataFrame, source: str) -> DataFrame:
    """(id, title, text, source) of raw rows; texts under 30 characters are dropped; without an id the text's hash is one."""
    plain = [F.col(c).cast("string") for c in df.columns if df.schema[c].dataType.typeName() not in ("array", "struct", "map")]
    text = t.strip(F.coalesce(first_of(df, TEXT_KEYS), F.concat_ws(" ", *plain)))
    own = F.coalesce(first_of(df, ID_KEYS), F.concat(F.lit(f"{source}:"), F.sha1(text.cast("binary"))))
    out = df.select(own.alias("id"), F.coalesce(first_of(df, TITLE_KEYS), own).alias("title"), text.alias("text"), F.lit(source).alias("source"), *place_of(df))
    return out.where(F.length("text") >= MIN_CHARS)


def normalize_qa(df: DataFrame, source: str) -> DataFrame:
    """(qid, text, answer, evidence, question_type, source) of raw rows with a query and an answer; evidence may be a list or JSON text."""
    own = {c.lower(): c for c in df.columns}
    listed = next((own[k] for k in EVIDENCE_KEYS if k in own), None)
    evidence: Column = F.array().cast(EVIDENCE)
    if listed:
        kind = df.schema[listed].dataType
        as_json = F.col(listed) if kind.typeName() == "string" else F.to_json(F.col(listed))
        evidence = F.coalesce(F.from_json(as_json, EVIDENCE), evidence)
    query = first_of(df, QUERY_KEYS)
    answer = F.coalesce(*[F.col(own[k]).cast("string") for k in ANSWER_KEYS if k in own]) if set(ANSWER_KEYS) & set(own) else F.lit(None).cast("string")
    kind = F.col(own["question_type"]).cast("string") if "question_type" in own else F.lit(None).cast("string")
    qid = F.coalesce(first_of(df, ["id", "query_id"]), F.concat(F.lit(f"{source}:"), F.sha1(query.cast("binary"))))
    out = df.select(qid.alias("qid"), query.alias("text"), answer.alias("answer"), evidence.alias("evidence"), F.coalesce(kind, F.lit("unknown")).alias("question_type"), F.lit(source).alias("source"), *place_of(df))
    return out.where("text is not null and answer is not null")


def dedupe(df: DataFrame, key: str, ordinal: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(ordinal))).where("_n = 1").drop("_n")


def evidence_first(documents: DataFrame, qa: DataFrame, limit: int | None, ordinal: str = "id") -> DataFrame:
    """Documents that are evidence, all of them, then others in order up to ``limit`` in all.

    One plan: the first ``limit`` others are picked by a partial sort, and as many of them stay as evidence leaves room.
    """
    if limit is None:
        return documents
    e = qa.select(F.explode("evidence").alias("e")).select("e.url", t.casefold(F.col("e.title")).alias("title")).distinct()
    urls = e.where("url <> ''").select(F.col("url").alias("_u")).distinct().withColumn("_a", F.lit(True))
    titles = e.where("title <> ''").select(F.col("title").alias("_t")).distinct().withColumn("_b", F.lit(True))
    marked = documents.join(urls, F.col("id").cast("string") == F.col("_u"), "left").join(titles, t.casefold(F.col("title")) == F.col("_t"), "left")
    marked = marked.withColumn("_p", F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))).select(*documents.columns, "_p")
    wanted = marked.where("_p").drop("_p")
    first = marked.where("not _p").drop("_p").orderBy(ordinal).limit(limit)
    numbered = first.withColumn("_n", F.row_number().over(Window.orderBy(ordinal)))  # ``limit`` rows
    rest = numbered.crossJoin(F.broadcast(wanted.agg(F.count("*").alias("_w")))).where(F.col("_n") <= limit - F.col("_w"))  # one row
    return wanted.unionByName(rest.drop("_n", "_w"))


def normalize_paragraph_qa(raw: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, questions) of rows (id, question, answer, paragraphs[idx, title, paragraph_text, is_supporting]).

    A paragraph is a document, named by the hash of title, idx and text; repeated paragraphs are one; supporting ones are evidence.
    """
    order = PLACE if PLACE in raw.columns else "id"
    rows = raw.orderBy(order).limit(limit) if limit else raw
    p = rows.select(F.col("id").cast("string").alias("qid"), F.posexplode("paragraphs").alias("n", "p"))
    text = t.strip(t.nvl("p.paragraph_text"))
    title = F.coalesce(F.nullif("p.title", F.lit("")), F.concat(F.lit("paragraph-"), F.col("p.idx").cast("string")))
    own = F.concat(F.lit("musique:"), F.substring(F.sha1(F.concat_ws("\n", title, F.col("p.idx").cast("string"), text).cast("binary")), 1, 16))
    docs = p.select(own.alias("id"), title.alias("title"), text.alias("text"), "qid", "n", F.col("p.idx").alias("paragraph_idx"), F.coalesce("p.is_supporting", F.lit(False)).alias("is_supporting"))
    docs = docs.where(F.length("text") >= MIN_CHARS)
    proof = docs.where("is_supporting").groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "id", "title"))), lambda e: F.struct(e["id"].alias("url"), e["title"].alias("title"))).alias("evidence"))
    asked = rows.select(F.col("id").cast("string").alias("qid"), first_of(rows, ["question", "composed_question_text", "question_text", "query_text"]).alias("text"), F.col("answer").cast("string").alias("answer"))
    qa = asked.where("text is not null and answer is not null").join(proof, "qid", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(EVIDENCE)))
    unique = dedupe(docs, "id", F.struct("qid", "n")).select("id", "title", "text", F.lit("musique_ans_dev").alias("source"))
    return unique, qa.withColumns({"hop_count": F.size("evidence"), "question_type": F.lit("unknown")})


def normalize_mixed(spark: SparkSession, paths: list[str], limit_docs: int | None = None, limit_qa: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, questions) of raw files of either kind, in the order of the files' names and of the rows in them."""
    docs = qa = None
    for order, path in enumerate(sorted(paths)):
        rows, name = read_raw(spark, path), path.rsplit("/", 1)[-1]
        make = normalize_qa if guess_kind(name, [c for c in rows.columns if c != PLACE]) == "qa" else normalize_documents
        found = make(rows, name).withColumn(PLACE, F.struct(F.lit(order).alias("order"), F.col(PLACE)))
        if make is normalize_qa:
            qa = found if qa is None else qa.unionByName(found)
        else:
            docs = found if docs is None else docs.unionByName(found)
    if docs is None or qa is None:
        raise ValueError("there must be a file of documents and one of questions")
    asked = qa.orderBy(PLACE).limit(limit_qa) if limit_qa else qa
    unique = dedupe(docs, "id", F.col(PLACE))
    return evidence_first(unique, asked, limit_docs, PLACE).drop(PLACE), asked.drop(PLACE)
