"""BM25 and dense similarity of whole tables of queries against whole tables of texts."""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import text as t
from ..storage import materialize

K1, B = 1.5, 0.75
#: Scores are rounded so that sums in another order rank alike.
DIGITS = 9


def tokens_of(texts: DataFrame, text: str) -> Column:
    """The column ``tokens`` if there is one, else the content tokens of the text."""
    return F.col("tokens") if "tokens" in texts.columns else t.content_tokens(F.col(text))


def postings(texts: DataFrame, by: list[str], text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(*by, term, tf, dl): occurrences of each content token in each text, with the length of the text in tokens.

    ``terms``: only tokens among its column ``term`` are counted; they are picked out before anything is shuffled.
    """
    own = texts.select(*by, tokens_of(texts, text).alias("_t"))
    each = own.select(*by, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term", "left_semi")
    return each.groupBy(*by, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(texts: DataFrame, corpus: list[str], text: str = "text") -> DataFrame:
    """(*corpus, n, avgdl) over all texts, empty ones included."""
    size = F.size(tokens_of(texts, text)).cast("double")
    return texts.groupBy(*corpus).agg(F.count("*").alias("n"), F.avg(size).alias("avgdl"))


def query_terms(queries: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(*by, term, qtf): how often each content token is in the query."""
    return queries.select(*by, F.explode(t.content_tokens(F.col(text))).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("qtf"))


def bm25(posts: DataFrame, stats: DataFrame, terms: DataFrame, query: list[str], corpus: list[str], item: list[str]) -> DataFrame:
    """(*query, *corpus, *item, score): BM25 of the texts that share a term with the query, divided by the query's best.

    ``posts``: postings of the terms of the queries (others are left aside), ``stats`` as above, ``terms`` from
    ``query_terms``.  Texts without a shared term score 0 and are left out.  Postings and sums are each written once and
    read twice; the best score of a query is a grouped maximum, so no query's texts meet in one task.
    """
    posts = materialize(posts.repartition(*corpus, *item), "postings")  # whole texts lie together, so that sums are partial per text
    df = posts.groupBy(*corpus, "term").agg(F.count("*").alias("df"))
    weighed = posts.join(df, [*corpus, "term"])
    weighed = weighed.join(stats, corpus) if corpus else weighed.crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl"))))
    impact = weighed.select(*corpus, *item, "term", part.alias("impact"))
    shared = [c for c in query if c in corpus]
    both = list(dict.fromkeys([*query, *corpus]))
    summed = impact.join(terms, ["term", *shared]).groupBy(*dict.fromkeys([*both, *item])).agg(F.sum(F.col("qtf") * F.col("impact")).alias("raw"))
    summed = materialize(summed, "sums")
    best = summed.groupBy(*both).agg(F.max("raw").alias("_best"))
    return summed.join(best, both).withColumn("score", F.round(F.col("raw") / F.col("_best"), DIGITS)).drop("raw", "_best")


# --- the best texts by bounds -----------------------------------------------------------------------------


class Best:
    """The ``k`` best texts of each of a set of queries in one corpus, batch by batch, by MaxScore.

    A term's part of a score is less than its weight, qtf x idf x (K1 + 1).  The terms of a query of smallest weight that
    together stay below its ``k``-th best score so far can't bring in a text alone: texts are found by the other, essential
    terms, and only those whose sum there and the weights of the rest reach the ``k``-th best are scored in full.
    Sums run in the order of the terms, so equal texts have equal scores to the last bit.
    """

    #: Sums that are held at once, and products that are added at once.
    CELLS, PRODUCTS = 1 << 22, 1 << 22

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, terms: int, k: int):
        order = np.lexsort((term, weight, query))
        self.query, self.term, self.weight = query[order], term[order], weight[order]
        self.n, self.terms, self.k = queries, terms, k
        self.first = np.searchsorted(self.query, np.arange(queries + 1))
        below = np.concatenate([[0.0], np.cumsum(self.weight)])
        self.upto = below[1:] - below[self.first[self.query]]  # weights of a query up to each of its terms
        self.all = below[self.first[1:]] - below[self.first[:-1]]
        self.by_term = np.argsort(self.term, kind="stable")
        self.least = np.zeros(queries)  # what a text must reach
        self.found: list[list[tuple[float, object]]] = [[] for _ in range(queries)]  # (-score, id), the best first
        self.dense = np.zeros(terms)

    def add(self, ids: list, text: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
        """Texts ``ids`` with their postings by text and term; ``part`` is tf / (tf + ..) of each."""
        step = max(1, self.CELLS // max(1, self.n))
        ends = np.searchsorted(text, np.arange(len(ids) + 1))
        at = 0
        while at < len(ids):
            reach = np.cumsum(np.bincount(self.term, minlength=self.terms)[term[ends[at] : ends[min(len(ids), at + step)]]])
            many = int(np.searchsorted(reach, self.PRODUCTS, "right")) + ends[at]
            until = max(at + 1, min(at + step, int(np.searchsorted(ends, many, "right")) - 1, len(ids)))
            a, b = ends[at], ends[until]
            self._add(ids[at:until], text[a:b] - at, term[a:b], part[a:b])
            at = until

    def _add(self, ids: list, text: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
        width = len(ids)
        essential = self.upto >= self.least[self.query]
        rest = np.bincount(self.query[~essential], self.weight[~essential], self.n)
        entry = self.by_term[essential[self.by_term]]
        many = np.bincount(self.term[entry], minlength=self.terms)
        start = np.cumsum(many) - many
        n = many[term]
        place = np.repeat(start[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        of = entry[place]
        cell = self.query[of] * width + np.repeat(text, n)
        sums = np.bincount(cell, self.weight[of] * np.repeat(part, n), self.n * width).reshape(self.n, width)
        hit = (sums > 0) & (sums + rest[:, None] >= self.least[:, None])
        ends = np.searchsorted(text, np.arange(width + 1))
        for q in np.flatnonzero(hit.any(axis=1)).tolist():
            which = np.flatnonzero(hit[q])
            score = sums[q, which] if not rest[q] else self._whole(q, which, ends, term, part)
            good = score >= self.least[q]
            if good.any():
                self._merge(q, [(-s, ids[i]) for s, i in zip(score[good].tolist(), which[good].tolist(), strict=True)])

    def _whole(self, q: int, which: np.ndarray, ends: np.ndarray, term: np.ndarray, part: np.ndarray) -> np.ndarray:
        own = slice(self.first[q], self.first[q + 1])
        self.dense[self.term[own]] = self.weight[own]
        n = ends[which + 1] - ends[which]
        at = np.repeat(ends[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = np.bincount(np.repeat(np.arange(len(which)), n), self.dense[term[at]] * part[at], len(which))
        self.dense[self.term[own]] = 0.0
        return out

    def _merge(self, q: int, new: list[tuple[float, object]]) -> None:
        """Keeps the best ``k``, and of scores that could be rounded to that of the last the first ``k`` ids each."""
        every = sorted(self.found[q] + new)
        if len(every) > self.k:
            near = every[self.k - 1][0] + 2 * 10.0**-DIGITS * self.all[q]
            kept, run = every[: self.k], 0
            last = every[self.k - 1][0]
            for x in every[self.k :]:
                if x[0] > near:
                    break
                run = run + 1 if x[0] == last else 1
                if x[0] != every[self.k - 1][0] and run <= self.k:
                    kept.append(x)
                last = x[0]
            every = kept
        if len(every) >= self.k:
            self.least[q] = max(0.0, -every[self.k - 1][0] - 2 * 10.0**-DIGITS * self.all[q])
        self.found[q] = every


def known_terms(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(.., dl, terms, tf): for rows (.., tokens) the number of tokens, and the numbers of those in ``vocabulary`` with their counts, in order."""
    names = [c for c in texts.columns if c != "tokens"]
    numbers = ArrayType(IntegerType())
    schema = StructType([*[texts.schema[c] for c in names], StructField("dl", LongType()), StructField("terms", numbers), StructField("tf", numbers)])
    arrow, sent = to_arrow_schema(schema), texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(sent.value, pa.string())
        for batch in (x for whole in batches for x in pieces(whole, len(names), 8 * TEXTS_AT_ONCE)):
            tokens = batch.column(len(names))
            text, term, tf, _ = counted_terms(tokens, terms)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, x.astype(np.int32)) for x in (term, tf)]
            columns = [*batch.columns[:-1], pc.list_value_length(tokens), *lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return texts.select(*names, "tokens").mapInArrow(run, schema)


def bm25_top_k(texts: DataFrame, queries: DataFrame, key: list[str], k: int = 80, corpus: str | None = None) -> DataFrame:
    """(*key, corpus, id, score): for each query (*key, text) and corpus the ``k`` texts of largest BM25 score above 0, divided by the query's best, ties by id.

    ``texts``: (id, tokens or text) and a column ``corpus``, if it is given, of a few names.  Texts stay where they are and are read once:
    what they have of the queries' terms is written as numbers, which the frequencies and then the scores are made of.  Each
    partition passes on its own ``k`` best of each query (see ``Best``), and only these are shuffled.  QUERIES_PER_PASS queries
    go through one pass over the texts; the driver and each task hold the terms of one pass.
    """
    names = [corpus] if corpus else []
    asked = query_terms(queries, key)
    passes = max(1, -(-queries.count() // QUERIES_PER_PASS))
    told = texts.select(*names, "id", tokens_of(texts, "text").alias("tokens"))
    if passes > 1 and "tokens" not in texts.columns:
        told = materialize(told, "tokens")
    kinds = [texts.schema[c] for c in (*names, "id")]
    schema = StructType([*queries.select(*key).schema.fields, *kinds, StructField("raw", DoubleType())])
    arrow = to_arrow_schema(schema)
    out = stats = None
    for p in range(passes):
        entries = asked.where(F.pmod(F.xxhash64(*key), F.lit(passes)) == p).collect()  # terms of QUERIES_PER_PASS queries
        vocabulary = sorted({r["term"] for r in entries})
        number = {term: i for i, term in enumerate(vocabulary)}
        asks = sorted({tuple(r[c] for c in key) for r in entries})
        place = {q: i for i, q in enumerate(asks)}
        q = np.array([place[tuple(r[c] for c in key)] for r in entries], np.int64)
        t_ = np.array([number[r["term"]] for r in entries], np.int64)
        qtf = np.array([r["qtf"] for r in entries], np.float64)
        counted = materialize(known_terms(told, vocabulary), "terms")
        if stats is None:
            sizes = counted.groupBy(*names).agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
            stats = {r[corpus] if corpus else None: (r["n"], r["avgdl"]) for r in sizes.collect()}  # a row a corpus
        df = {name: np.zeros(len(vocabulary)) for name in stats}
        for r in counted.select(*names, F.explode("terms").alias("term")).groupBy(*names, "term").agg(F.count("*").alias("df")).collect():
            df[r[corpus] if corpus else None][r["term"]] = r["df"]  # at most the terms of a pass, for each corpus
        idf = {name: np.log(1 + (stats[name][0] - d + 0.5) / (d + 0.5)) for name, d in df.items()}
        model = texts.sparkSession.sparkContext.broadcast((len(vocabulary), asks, q, t_, qtf, idf, {name: float(s[1] or 0.0) for name, s in stats.items()}))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            size, asks, q, t_, qtf, idf, length = model.value
            best: dict[object, Best] = {}
            for batch in (x for whole in batches for x in pieces(whole, whole.num_columns - 1, 8 * TEXTS_AT_ONCE)):
                own = batch.column(0).to_pylist() if corpus else [None] * batch.num_rows
                for name in dict.fromkeys(own):
                    part = batch.filter(pa.array([x == name for x in own])) if corpus else batch
                    if name not in best:
                        best[name] = Best(q, t_, qtf * idf[name][t_] * (K1 + 1), len(asks), size, k)
                    ids, dl, term, tf = part.columns[-4:]
                    text = np.repeat(np.arange(part.num_rows), pc.list_value_length(term).to_numpy(zero_copy_only=False))
                    dl = dl.to_numpy(zero_copy_only=False).astype(np.float64)[text]
                    term, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in (term, tf))
                    best[name].add(ids.to_pylist(), text, term.astype(np.int64), tf / (tf + K1 * (1 - B + B * dl / max(1.0, length[name]))))
            for name, b in best.items():
                rows = [(*asks[i], *([name] if corpus else []), x[1], -x[0]) for i, found in enumerate(b.found) for x in found]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        found = counted.where(F.size("terms") > 0).mapInArrow(run, schema)
        found = materialize(found, "best")
        out = found if out is None else out.unionByName(found)
    top = out.groupBy(*key, *names).agg(F.max("raw").alias("_best"))
    scored = out.join(top, [*key, *names]).withColumn("score", F.round(F.col("raw") / F.col("_best"), DIGITS)).drop("raw", "_best")
    order = Window.partitionBy(*key, *names).orderBy(F.desc("score"), "id")
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def best_parts(wholes: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, position): the part of each whole that suits a query best, its own parts being the corpus; the first of equals, none without a shared term.

    ``wholes``: (id, units: an array of (position, tokens), qids: the queries (qid, text) that want it).  The terms of QUERIES_PER_PASS queries
    go through one pass; a task weighs the parts of one whole at a time.
    """
    asked = query_terms(queries, ["qid"])
    passes = max(1, -(-queries.count() // QUERIES_PER_PASS))
    schema = StructType([queries.schema["qid"], wholes.schema["id"], StructField("position", IntegerType())])
    arrow = to_arrow_schema(schema)
    wholes = wholes.select("id", "qids", F.transform("units", lambda u: u["position"].cast("int")).alias("at"), F.transform("units", lambda u: u["tokens"]).alias("tokens"))
    out = None
    for p in range(passes):
        terms: dict[object, dict[str, int]] = {}
        for r in asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p).collect():  # terms of QUERIES_PER_PASS queries
            terms.setdefault(r["qid"], {})[r["term"]] = r["qtf"]
        vocabulary = sorted({x for own in terms.values() for x in own})
        number = {x: i for i, x in enumerate(vocabulary)}
        weights = {q: (np.array([number[x] for x in own], np.int64), np.array(list(own.values()), np.float64)) for q, own in terms.items()}
        sent = queries.sparkSession.sparkContext.broadcast((vocabulary, weights))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocabulary, weights = sent.value
            known, qtf = pa.array(vocabulary, pa.string()), np.zeros(len(vocabulary))
            for batch in (whole.slice(i, 1) for whole in batches for i in range(whole.num_rows)):
                rows = []
                own, qids, at = (batch.column(i)[0].as_py() for i in range(3))
                tokens = batch.column(3).flatten()
                text, term, tf, dl = counted_terms(tokens, known)
                df = np.bincount(term, minlength=len(vocabulary))[term]
                length = max(1.0, float(pc.mean(pc.list_value_length(tokens)).as_py()))
                impact = np.log(1 + (len(at) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / length))
                for q in qids:
                    if q in weights and len(term):
                        place, many = weights[q]
                        qtf[place] = many
                        raw = np.bincount(text, qtf[term] * impact, len(at))
                        qtf[place] = 0.0
                        if (top := raw.max()) > 0:
                            score = np.round(raw / top, DIGITS)
                            rows.append((q, own, min(n for n, s in zip(at, score.tolist(), strict=True) if s == score.max())))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        found = wholes.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def filled_top_k(texts: DataFrame, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    """(*key, id, score, rank): the first ``k`` texts of each query by (-score, id), those without a match score 0.

    Texts without a match come by id, so the first ``k`` ids are all that can be needed of them.
    """
    head = texts.select("id").orderBy("id").limit(k)
    zeros = queries.select(*key).crossJoin(F.broadcast(head)).withColumn("score", F.lit(0.0))  # ``k`` rows
    both = bm25_top_k(texts, queries, key, k).unionByName(zeros).groupBy(*key, "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Texts, and tokens unless one text has more, that are counted at once.
TEXTS_AT_ONCE, TOKENS_AT_ONCE = 1024, 1 << 20


def pieces(batch: pa.RecordBatch, column: int, texts: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``texts`` (none: TEXTS_AT_ONCE) rows and TOKENS_AT_ONCE tokens in ``column``, so that memory follows neither batch nor texts."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        until = min(at + (texts or TEXTS_AT_ONCE), max(at + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, "right"))))
        yield batch.slice(at, until - at)
        at = until


def counted_terms(tokens: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf, dl) of the tokens that are among ``terms``, by text and term."""
    dl = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(dl)), dl)
    cell, tf = np.unique((text * len(terms) + found)[found >= 0], return_counts=True)
    text, term = cell // max(1, len(terms)), cell % max(1, len(terms))
    return text, term, tf.astype(np.float64), dl[text].astype(np.float64)


# --- dense similarity ---------------------------------------------------------------------------------


def hashed_place(token: str, dimensions: int = 256) -> tuple[int, float]:
    """Place and sign of a token: BLAKE2b of 8 bytes, its value mod ``dimensions`` and its first bit."""
    digest = hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest()
    return int.from_bytes(digest, "big") % dimensions, 1.0 if digest[0] & 1 else -1.0


#: Turns lists of content tokens and texts into unit vectors; replaceable by a model.
Embedder = Callable[[list[list[str]], list[str]], np.ndarray]


def hashed_embedder(token_lists: list[list[str]], texts: list[str] | None = None, dimensions: int = 256) -> np.ndarray:
    """Unit vectors of signed token counts, zero without tokens."""
    size = np.array([len(x) for x in token_lists], np.int64)
    places = {token: hashed_place(token, dimensions) for token in {token for x in token_lists for token in x}}
    found = np.array([places[token] for x in token_lists for token in x]).reshape(-1, 2)
    row = np.repeat(np.arange(len(size)), size)
    v = np.bincount(row * dimensions + found[:, 0].astype(np.int64), found[:, 1], len(size) * dimensions).reshape(len(size), dimensions)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1.0)


def hashed_rows(tokens: pa.Array, dimensions: int = 256) -> np.ndarray:
    """The same for an Arrow array of token lists; each distinct token is hashed once."""
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    places = np.array([hashed_place(token, dimensions) for token in coded.dictionary.to_pylist()]).reshape(-1, 2)
    found = places[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(size)), size)
    v = np.bincount(row * dimensions + found[:, 0].astype(np.int64), found[:, 1], len(size) * dimensions).reshape(len(size), dimensions)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1.0)


@F.pandas_udf(DoubleType())
def hashed_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the hashed vectors of two token lists, not below 0."""
    dot = np.einsum("ij,ij->i", hashed_embedder([list(x) for x in a]), hashed_embedder([list(x) for x in b]))
    return pd.Series(np.round(np.maximum(0.0, dot), DIGITS))


#: Queries that go through one pass over the texts; their vectors are the only thing sent to the executors.
QUERIES_PER_PASS = 4096


def passed(queries: DataFrame, texts: DataFrame, key: list[str], schema, embedder: Embedder, run: Callable, arrow: bool = False) -> DataFrame:
    """The rows that ``run(keys, matrix of the queries, batches of texts)`` gives, over all queries; ``arrow``: batches of (id, tokens) in that form.

    More than QUERIES_PER_PASS queries go in several passes, the rows of each of which are written before the next begins,
    so the driver holds the queries of one pass.
    """
    told = texts.select("id", F.col("text") if "text" in texts.columns else F.lit("").alias("text"), tokens_of(texts, "text").alias("_t"))
    own = queries.select(*key, "text", t.content_tokens(F.col("text")).alias("_t"))
    n = max(1, -(-queries.count() // QUERIES_PER_PASS))
    out = None
    for p in range(n):
        part = own.where(F.pmod(F.xxhash64(*key), F.lit(n)) == p).collect()  # about QUERIES_PER_PASS
        matrix = embedder([r["_t"] for r in part], [r["text"] for r in part]) if part else np.zeros((0, 1))
        keys = [tuple(r[c] for c in key) for r in part]
        own_texts = told.select("id", "_t") if arrow else told
        own_texts = own_texts if part else own_texts.limit(0)
        found = (own_texts.mapInArrow if arrow else own_texts.mapInPandas)(lambda batches, keys=keys, matrix=matrix: run(keys, matrix, batches), schema)
        found = found if n == 1 else materialize(found, "pass")
        out = found if out is None else out.unionByName(found)
    return out


class Nearest:
    """The ``k`` texts of largest score of each query, ties by id; memory grows with queries x ``k``, not with the texts seen."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.found: list[list[tuple[float, object]]] = [[] for _ in range(queries)]  # (-score, id), the best first

    def add(self, ids: list, scores: np.ndarray) -> None:
        """``scores`` (queries, ids)."""
        reach = scores >= self.least[:, None]
        for q in np.flatnonzero(reach.any(axis=1)).tolist():
            which = np.flatnonzero(reach[q])
            own = scores[q, which]
            if len(which) > self.k:  # of equal scores all stay until ids decide
                cut = np.partition(own, len(own) - self.k)[len(own) - self.k]
                which, own = which[own >= cut], own[own >= cut]
            best = heapq.nsmallest(self.k, itertools.chain(self.found[q], ((-s, ids[i]) for s, i in zip(own.tolist(), which.tolist(), strict=True))))
            self.found[q] = best
            if len(best) == self.k:
                self.least[q] = -best[-1][0]

    def rows(self) -> Iterator[tuple[int, object, float]]:
        return ((q, i, -s) for q, found in enumerate(self.found) for s, i in found)


def dense_top_k(queries: DataFrame, texts: DataFrame, key: list[str], k: int = 80, embedder: Embedder = hashed_embedder) -> DataFrame:
    """(*key, id, score): for each query (*key, text) the ``k`` texts (id, text or tokens) of largest non-negative cosine, ties by id.

    The texts stream once for every QUERIES_PER_PASS queries, TEXTS_AT_ONCE at a time; each partition keeps its own best ``k`` of a query
    and nothing else (see ``Nearest``), and only those are shuffled.
    """
    schema = queries.select(*key).schema.add("id", texts.schema["id"].dataType).add("score", "double")

    def search(keys: list[tuple], matrix: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = Nearest(len(keys), k)
        for pdf in batches:
            for at in range(0, len(pdf), TEXTS_AT_ONCE):
                part = pdf.iloc[at : at + TEXTS_AT_ONCE]
                nearest.add(part["id"].to_list(), np.round(np.maximum(0.0, matrix @ embedder([list(x) for x in part["_t"]], list(part["text"])).T), DIGITS))
        yield pd.DataFrame([(*keys[q], i, s) for q, i, s in nearest.rows()], columns=[*key, "id", "score"])

    arrow = to_arrow_schema(schema)

    def search_tokens(keys: list[tuple], matrix: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(len(keys), k)
        for whole in batches:
            for batch in pieces(whole, 1):
                nearest.add(batch.column(0).to_pylist(), np.round(np.maximum(0.0, matrix @ hashed_rows(batch.column(1)).T), DIGITS))
        columns = list(zip(*[(*keys[q], i, s) for q, i, s in nearest.rows()], strict=True)) or [[] for _ in arrow]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    plain = embedder is hashed_embedder  # which needs no text
    out = passed(queries, texts, key, schema, embedder, search_tokens if plain else search, plain)
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    return out.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def dense_scores(queries: DataFrame, texts: DataFrame, embedder: Embedder = hashed_embedder, chunk: int = 1024) -> DataFrame:
    """(qid, id, embedding): the non-negative cosine of every query (qid, text) and every text (id, text or tokens), by products of matrices."""
    schema = queries.select("qid").schema.add("id", texts.schema["id"].dataType).add("embedding", "double")

    def run(keys: list[tuple], matrix: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids = np.array([k[0] for k in keys], object)
        for pdf in batches:
            for at in range(0, len(pdf), chunk):
                part = pdf.iloc[at : at + chunk]
                scores = np.round(np.maximum(0.0, matrix @ embedder([list(x) for x in part["_t"]], list(part["text"])).T), DIGITS)
                yield pd.DataFrame({"qid": np.repeat(qids, len(part)), "id": np.tile(part["id"].to_numpy(), len(qids)), "embedding": scores.ravel()})

    return passed(queries, texts, ["qid"], schema, embedder, run)


# --- the texts that a choice under a budget can need ------------------------------------------------------


class Foremost:
    """Of each query the texts that can be among the ``k`` best of their class, that is of their number of tokens, batch by batch.

    With ``lone`` a text is needed only if fewer than ``k`` texts of as many tokens or fewer are better.  Scores are known up to
    ``margin``; of texts alike in score and ``utility`` the first ``k`` items each are kept, unless ``ties`` is off.
    """

    #: Classes that have a bar of their own (larger ones are sorted out later), and pairs that are held before they are sorted out.
    CLASSES, PAIRS = 2048, 1 << 18

    def __init__(self, queries: int, k: int, margin: float, lone: bool, ties: bool = True):
        self.k, self.margin, self.lone, self.ties = k, margin, lone, ties
        self.bar = np.full((queries, self.CLASSES + 1), -np.inf)
        self.ids: list = []
        self.items = np.empty(0, str)
        self.size = np.empty(0, np.int64)
        self.pairs: list[tuple[np.ndarray, ...]] = []  # query, text, score, utility, bm25, embedding
        self.held = 0

    def add(self, ids: list, size: np.ndarray, score: np.ndarray, utility: np.ndarray, *features: np.ndarray) -> None:
        """Texts of ``size`` tokens with their score, utility and features, matrices (queries, texts)."""
        q, text = np.nonzero(score >= self.bar[:, np.minimum(size, self.CLASSES)] - self.margin)
        if not len(q):
            return
        own, back = np.unique(text, return_inverse=True)
        self.pairs.append((q, back + len(self.ids), *(m[q, text] for m in (score, utility, *features))))
        self.ids += [ids[i] for i in own.tolist()]
        self.items = np.concatenate([self.items, np.array([str(ids[i]) for i in own.tolist()], str)])
        self.size = np.concatenate([self.size, size[own]])
        self.held += len(q)
        if self.held > self.PAIRS:
            self.sort_out()

    def sort_out(self) -> None:
        if not self.pairs:
            return
        q, text, score, utility, *features = (np.concatenate(c) for c in zip(*self.pairs, strict=True))
        name = np.unique(self.items, return_inverse=True)[1]
        size = self.size[text]
        order = np.lexsort((name[text], utility, -score, size, q))
        q, text, score, utility, size = (x[order] for x in (q, text, score, utility, size))
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (size[1:] != size[:-1])])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(q)))
        if self.lone:
            least = self._climb(q, size, score)
        else:
            kth = np.full(len(first), -np.inf)
            full = many >= self.k
            kth[full] = score[first[full] + self.k - 1]
            least = np.repeat(kth, many)
            small = size[first] < self.CLASSES
            self.bar[q[first[small]], size[first[small]]] = np.maximum(self.bar[q[first[small]], size[first[small]]], kth[small])
        keep = score >= least - self.margin
        if self.ties:
            run = new | np.concatenate([[True], (score[1:] != score[:-1]) | (utility[1:] != utility[:-1])])
            at = np.flatnonzero(run)
            keep &= np.arange(len(q)) - np.repeat(at, np.diff(np.append(at, len(q)))) < self.k
        used, back = np.unique(text[keep], return_inverse=True)
        self.ids, self.items, self.size = [self.ids[i] for i in used.tolist()], self.items[used], self.size[used]
        self.pairs = [(q[keep], back, score[keep], utility[keep], *(f[order][keep] for f in features))]
        self.held = 0

    def _climb(self, q: np.ndarray, size: np.ndarray, score: np.ndarray) -> np.ndarray:
        """For each pair, by query and size, the ``k``-th best score among those before it and the best of its size; sets the bars."""
        least, best, last, bar = np.empty(len(q)), [], -1, None
        for i, (own, n, s) in enumerate(zip(q.tolist(), size.tolist(), score.tolist(), strict=True)):
            if own != last:
                last, best, bar = own, [], self.bar[own]
            least[i] = best[0] if len(best) == self.k else -np.inf
            if len(best) < self.k:
                heapq.heappush(best, s)
            elif s > best[0]:
                heapq.heapreplace(best, s)
            if len(best) == self.k and n < self.CLASSES and best[0] > bar[n]:
                bar[n] = best[0]
        np.maximum.accumulate(self.bar[:, :-1], axis=1, out=self.bar[:, :-1])
        return least

    def rows(self) -> tuple[np.ndarray, list, list[np.ndarray]]:
        """(queries, ids, features) of the pairs that are left."""
        self.sort_out()
        if not self.pairs:
            return np.empty(0, np.int64), [], [np.empty(0)] * 2
        q, text, _, _, *features = self.pairs[0]
        return q, [self.ids[i] for i in text.tolist()], list(features)


def foremost(
    queries: DataFrame, texts: DataFrame, k: int, weights: tuple[float, float, float, float], intents: list[str], margin: float, lone: bool, ties: bool, embedder: Embedder | None,
) -> DataFrame:
    """(qid, id, bm25, embedding): for each query the texts that ``Foremost`` keeps, with BM25 over the query's best and, with ``embedder``, their non-negative cosine.

    ``queries``: (qid, text, intent), ``texts``: (id, tokens, token_count, specificity, factor, fits, and text for a model); fits is the
    intent match for each of ``intents``.  A pair is weighed by the clipped sum of ``weights`` times (bm25, embedding, intent match,
    specificity), times the factor.  The texts stay where they are: what they have of the queries' terms is written as numbers, of
    which first each query's best sum and then the scores are made, so no table of pairs is written or shuffled.
    """
    asked = query_terms(queries, ["qid"])
    passes = max(1, -(-queries.count() // QUERIES_PER_PASS))
    model_reads = embedder is not None and embedder is not hashed_embedder
    beside = ["id", "token_count", "specificity", "factor", "fits"] + ["text"] * model_reads + ["_own"] * (embedder is not None)
    told = texts.withColumn("_own", F.col("tokens")) if embedder is not None else texts
    told = told.select(*beside, "tokens")
    schema = StructType([queries.schema["qid"], texts.schema["id"], StructField("bm25", DoubleType()), StructField("embedding", DoubleType())])
    arrow = to_arrow_schema(schema)
    out = stats = None
    for p in range(passes):
        mine = F.pmod(F.xxhash64("qid"), F.lit(passes)) == p
        part = queries.where(mine).select("qid", "text", "intent", t.content_tokens(F.col("text")).alias("_t")).collect()  # QUERIES_PER_PASS queries
        place = {r["qid"]: i for i, r in enumerate(part)}
        entries = asked.where(mine).collect()
        vocabulary = sorted({r["term"] for r in entries})
        number = {term: i for i, term in enumerate(vocabulary)}
        q = np.array([place[r["qid"]] for r in entries], np.int64)
        t_ = np.array([number[r["term"]] for r in entries], np.int64)
        qtf = np.array([r["qtf"] for r in entries], np.float64)
        counted = materialize(known_terms(told, vocabulary), "terms")
        if stats is None:
            stats = counted.agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl")).first()
        df = np.zeros(len(vocabulary))
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
            df[r["term"]] = r["df"]  # at most the terms of a pass
        weight = qtf * np.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))[t_] * (K1 + 1) if len(q) else qtf
        length, size, n = max(1.0, float(stats["avgdl"] or 0.0)), len(vocabulary), len(part)

        def postings_of(batch: pa.RecordBatch, length: float = length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            dl, term, tf = batch.columns[-3:]
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(term).to_numpy(zero_copy_only=False))
            dl = dl.to_numpy(zero_copy_only=False).astype(np.float64)[text]
            term, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in (term, tf))
            return text, term.astype(np.int64), tf / (tf + K1 * (1 - B + B * dl / length))

        def top(batches: Iterator[pa.RecordBatch], q=q, t_=t_, weight=weight, n=n, size=size, postings_of=postings_of) -> Iterator[pa.RecordBatch]:
            best = Best(q, t_, weight, n, size, 1)
            for batch in (x for whole in batches for x in pieces(whole, whole.num_columns - 2, 8 * TEXTS_AT_ONCE)):
                best.add(list(range(batch.num_rows)), *postings_of(batch))
            found = [(i, -x[0][0]) for i, x in enumerate(best.found) if x]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64())], ["place", "raw"])

        most = np.ones(n)
        for r in counted.where(F.size("terms") > 0).select("dl", "terms", "tf").mapInArrow(top, "place int, raw double").groupBy("place").agg(F.max("raw").alias("raw")).collect():
            most[r["place"]] = r["raw"]  # a row a query
        matrix = embedder([r["_t"] for r in part], [r["text"] for r in part]) if embedder is not None and part else None
        fit = np.array([intents.index(r["intent"]) for r in part], np.int64)
        by_term = np.argsort(t_, kind="stable")
        start = np.searchsorted(t_[by_term], np.arange(size + 1))
        sent = queries.sparkSession.sparkContext.broadcast(([r["qid"] for r in part], q[by_term], weight[by_term], start, most, matrix, fit))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, postings_of=postings_of) -> Iterator[pa.RecordBatch]:
            qids, query, weight, start, most, matrix, fit = sent.value
            n = len(qids)
            kept = Foremost(n, k, margin, lone, ties)
            at_once = max(1, min(TEXTS_AT_ONCE, Best.CELLS // max(1, n)))
            for batch in (x for whole in batches for x in pieces(whole, whole.num_columns - 2, at_once) if n):
                width = batch.num_rows
                text, term, part = postings_of(batch)
                sums = np.zeros(n * width)
                for a in range(0, len(term), 1 << 14):  # a few postings at a time: each has an entry for every query with the term
                    te, tx, pt = term[a : a + (1 << 14)], text[a : a + (1 << 14)], part[a : a + (1 << 14)]
                    m = start[te + 1] - start[te]
                    of = np.repeat(start[te] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    np.add.at(sums, query[of] * width + np.repeat(tx, m), weight[of] * np.repeat(pt, m))
                bm25 = np.round(sums.reshape(n, width) / most[:, None], DIGITS)
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
                near = np.zeros((n, width))
                if matrix is not None:
                    own = column("_own")
                    rows = embedder(own.to_pylist(), column("text").to_pylist()) if model_reads else hashed_rows(own)
                    near = np.round(np.maximum(0.0, matrix @ rows.T), DIGITS)
                fits = np.array(column("fits").to_pylist(), float).reshape(width, -1).T[fit] if n else near
                numbers = {c: column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("specificity", "factor")}
                utility = weights[0] * bm25 + weights[1] * near + weights[2] * fits + weights[3] * numbers["specificity"]
                utility = np.clip(utility, 0.0, 1.0)
                kept.add(column("id").to_pylist(), column("token_count").to_numpy(zero_copy_only=False).astype(np.int64), utility * numbers["factor"], utility, bm25, near)
            q, ids, features = kept.rows()
            for a in range(0, len(ids), 1 << 16):
                some = slice(a, a + (1 << 16))
                columns = [[qids[i] for i in q[some].tolist()], ids[some], *(f[some] for f in features)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        found = counted.mapInArrow(run, schema)
        found = found if passes == 1 else materialize(found, "pass")
        out = found if out is None else out.unionByName(found)
    return out


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score): dense cosine of array columns, for each query the ``k`` best others, ties by id.

    ``queries`` and ``vectors``: (id, embedding).  The vectors stream past the queries, QUERIES_PER_PASS at a time, in products of
    matrices; a partition passes on its own best.  Queries and vectors that are null or zero have none.
    """
    n = max(1, -(-queries.count() // QUERIES_PER_PASS))
    schema = queries.select(F.col("id").alias("query_id")).schema.add("id", vectors.schema["id"].dataType).add("score", "double")
    out = None
    for p in range(n):
        part = queries.where("embedding is not null").where(F.pmod(F.xxhash64("id"), F.lit(n)) == p).collect()  # about QUERIES_PER_PASS
        found = vectors.where("embedding is not null").select("id", "embedding").mapInPandas(vector_search([r["id"] for r in part], [r["embedding"] for r in part], k), schema)
        found = found if n == 1 else materialize(found, "pass")
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("query_id", "id", "score")


def unit_rows(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64).reshape(len(vectors), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def vector_search(keys: list, vectors: list, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    asked = unit_rows(vectors) if keys else np.zeros((0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = Nearest(len(keys), k + 1)  # a query finds itself
        for pdf in batches:
            for at in range(0, len(pdf) if keys else 0, TEXTS_AT_ONCE):
                part = pdf.iloc[at : at + TEXTS_AT_ONCE]
                nearest.add(part["id"].to_list(), np.round(np.maximum(0.0, asked @ unit_rows(list(part["embedding"])).T), DIGITS))
        rows = [(keys[q], i, s) for q, i, s in nearest.rows() if i != keys[q]]
        yield pd.DataFrame(rows, columns=["query_id", "id", "score"])

    return run
