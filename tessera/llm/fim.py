"""Fill-in-the-middle: documents are cut into prefix, middle and suffix at line ends and put together anew.

Lines are counted, and sentinels that a text may hold by itself are found, by one finite automaton.  A text is
scanned in chunks that know nothing of each other: a chunk gives the automaton's transition function (the state
in which it ends for every state in which it may begin) and, for every such state, the number of lines that
begin in it.  Functions compose associatively: inside a chunk by a tree over its characters, over the chunks of
a document by blocks.  Once the state in which each chunk begins is known, a cut at a line number lies in one
chunk, and only that chunk is read again to find the character.

A text of one chunk needs no exchange.  The chunks of longer texts are dealt to all tasks by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import Emitter, arrow_schema, fresh, materialize, row_name, rows

#: Code points of a chunk, and chunks of a block.  A text has less than 2**31 bytes, so at most 128 blocks.
CHUNK, BLOCK = 1 << 16, 256
#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Largest number of rows in the table of functions of several characters.
TABLE = 8192

Function = tuple[np.ndarray, np.ndarray]


def compose(first: Function, then: Function) -> Function:
    """Row by row, the function of ``first`` and after it ``then``: (end states, lines begun) by the state at the start."""
    at = first[0].astype(np.intp)
    return np.take_along_axis(then[0], at, 1), first[1] + np.take_along_axis(then[1], at, 1)


class Automaton:
    """State: whether a line is about to begin, and how much of a sentinel was just read; a whole one is never forgotten.

    State 0 is that of the start of a text.
    """

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        parts = sorted({s[:k] for s in sentinels for k in range(len(s))} | {""}, key=lambda p: (len(p), p))
        self.found = len(parts)
        self.marks = self.found + 1
        states = 2 * self.marks
        chars = sorted({c for s in sentinels for c in s} | {"\n"})

        def after(mark: int, c: str) -> int:
            read = parts[mark] + c if mark < self.found else ""
            if mark == self.found or any(read.endswith(s) for s in sentinels):
                return self.found
            return max(k for k, p in enumerate(parts) if read.endswith(p))

        ends = [[(c != "\n") * self.marks + after(s % self.marks, c) for s in range(states)] for c in [*chars, "\0"]]
        begun = [[int(s < self.marks) for s in range(states)]] * len(ends)
        self.same: Function = np.arange(states, dtype=np.uint8)[None], np.zeros((1, states), np.int64)
        single = np.vstack([np.array(ends, np.uint8), self.same[0]]), np.vstack([np.array(begun, np.int64), self.same[1]])
        # class of a character: its place among ``chars``, then any other, then none at all
        self.classes = len(chars) + 2
        self.lookup = np.full(ord(chars[-1]) + 2, len(chars), np.int64)
        self.lookup[[ord(c) for c in chars]] = range(len(chars))
        self.width, self.table = 1, single
        while len(self.table[0]) * self.classes <= TABLE:
            n = len(self.table[0])
            longer = [np.repeat(x, self.classes, 0) for x in self.table], [np.tile(x, (n, 1)) for x in single]
            self.table, self.width = compose(*longer), self.width + 1

    def scan(self, text: str) -> Function:
        """The function of a piece of text, as one row."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = np.full(-(-len(codes) // self.width) * self.width, self.classes - 1, np.int64)
        classes[: len(codes)] = self.lookup[np.minimum(codes, len(self.lookup) - 1)]
        group = classes.reshape(-1, self.width) @ (self.classes ** np.arange(self.width - 1, -1, -1))
        return self.fold((self.table[0][group], self.table[1][group]))

    def fold(self, of: Function) -> Function:
        """All rows composed in order, in a tree."""
        if not len(of[0]):
            return self.same
        while len(of[0]) > 1:
            if len(of[0]) % 2:
                of = np.vstack([of[0], self.same[0]]), np.vstack([of[1], self.same[1]])
            of = compose((of[0][0::2], of[1][0::2]), (of[0][1::2], of[1][1::2]))
        return of


def pieces(text: str) -> list[str]:
    return [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]


def line_start(piece: Column, skip: Column, fresh_line: Column) -> Column:
    """Where in ``piece`` the line begins before which ``skip`` others do; it begins with one if ``fresh_line``."""
    ends = skip + F.when(fresh_line, 0).otherwise(1)
    return F.when(ends == 0, F.lit(0)).otherwise(F.char_length(F.call_function("substring_index", piece, F.lit("\n"), ends.cast("int"))) + 1)


def _short(df: DataFrame, sentinels: tuple[str, ...]) -> DataFrame:
    """``df`` (.., text) with n_lines and marked, for texts of one chunk."""
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sentinels)
        for batch in batches:
            found = [automaton.scan(x or "") for x in batch.column(width - 1).to_pylist()]
            lines = pa.array([int(f[1][0, 0]) for f in found], pa.int64())
            marked = pa.array([int(f[0][0, 0]) % automaton.marks == automaton.found for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, lines, marked], [*batch.schema.names, "n_lines", "marked"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("n_lines", LongType()), StructField("marked", BooleanType())]))


def _walk(automaton: Automaton, pdf: pd.DataFrame, entry: int, begun: int, offset: int) -> list[tuple[int, int, int]]:
    """(entry state, lines begun before, characters before) of each row of functions in order, and what follows the last."""
    out = [(entry, begun, offset)]
    for ends, counts, chars in zip(pdf["ends"], pdf["counts"], pdf["chars"], strict=True):
        entry, begun, offset = int(ends[entry]), begun + int(counts[entry]), offset + int(chars)
        out.append((entry, begun, offset))
    return out


def _long(df: DataFrame, sentinels: tuple[str, ...]) -> DataFrame:
    """(name, n_lines, marked, first_cut, second_cut) of each ``name`` of ``df`` (name, h1, h2, text): texts of more than one chunk."""
    function = "chars long, ends array<int>, counts array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = Emitter(arrow_schema(name=pa.string(), k=pa.int32(), piece=pa.string()), 16)
            for name, text in zip(*rows(batch, "name", "text"), strict=True):
                for k, piece in enumerate(pieces(text)):
                    e.add(name, k, piece)
                    if e.full():
                        yield e.take()
            yield e.take()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sentinels)
        for batch in batches:
            e = Emitter(arrow_schema(name=pa.string(), k=pa.int32(), chars=pa.int64(), ends=pa.list_(pa.int32()), counts=pa.list_(pa.int64())))
            for name, k, piece in zip(*rows(batch, "name", "k", "piece"), strict=True):
                ends, counts = automaton.scan(piece)
                e.add(name, k, len(piece), ends[0].tolist(), counts[0].tolist())
            yield e.take()

    def blocks_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        ends, counts = Automaton(sentinels).fold((np.vstack(pdf["ends"]).astype(np.uint8), np.vstack(pdf["counts"])))
        return pd.DataFrame({"name": pdf["name"].iloc[:1], "block": pdf["block"].iloc[0], "chars": pdf["chars"].sum(), "ends": [ends[0].tolist()], "counts": [counts[0].tolist()]})

    def entries_of(pdf: pd.DataFrame) -> pd.DataFrame:
        automaton, pdf = Automaton(sentinels), pdf.sort_values("block")
        found = _walk(automaton, pdf, 0, 0, 0)
        out = pd.DataFrame(found[:-1], columns=["entry", "begun", "offset"])
        out.insert(0, "name", pdf["name"].to_numpy())
        out.insert(1, "block", pdf["block"].to_numpy())
        return out.assign(n_lines=found[-1][1], n_chars=found[-1][2], marked=found[-1][0] % automaton.marks == automaton.found)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        automaton, pdf = Automaton(sentinels), pdf.sort_values("k")
        found = _walk(automaton, pdf, *(int(pdf[c].iloc[0]) for c in ("entry", "begun", "offset")))
        places = dict(zip(("fresh", "begun", "offset"), zip(*[(a < automaton.marks, b, c) for a, b, c in found[:-1]], strict=True), strict=True))
        return pd.DataFrame({"name": pdf["name"].to_numpy(), "k": pdf["k"].to_numpy(), **places, "until": [x[1] for x in found[1:]]})

    chunks = materialize(df.select("name", "text").mapInArrow(cut, "name string, k int, piece string").repartition("name", "k"), "chunks")
    scanned = chunks.mapInArrow(scan, f"name string, k int, {function}").dropDuplicates(["name", "k"]).withColumn("block", F.expr(f"k div {BLOCK}").cast("int"))
    functions = materialize(scanned, "functions")
    blocks = functions.groupBy("name", "block").applyInPandas(blocks_of, f"name string, block int, {function}")
    entries = materialize(
        blocks.groupBy("name").applyInPandas(entries_of, "name string, block int, entry int, begun long, offset long, n_lines long, n_chars long, marked boolean"), "entries"
    )
    at = functions.join(entries.select("name", "block", "entry", "begun", "offset"), ["name", "block"])
    at = at.groupBy("name", "block").applyInPandas(inside, "name string, k int, fresh boolean, begun long, offset long, until long")
    whole = entries.where("block = 0").select("name", "n_lines", "n_chars", "marked")
    drawn = df.select("name", "h1", "h2").dropDuplicates(["name"]).join(whole, "name")
    drawn = drawn.withColumns({f"u{i}": F.pmod(f"h{i}", F.col("n_lines") + 1) for i in (1, 2)})
    wanted = drawn.select("name", F.explode(F.array_distinct(F.array("u1", "u2"))).alias("u"))
    spots = at.join(wanted, "name").where("begun <= u and u < until").select("name", "k", "u", "offset", "fresh", (F.col("u") - F.col("begun")).alias("skip"))
    placed = spots.join(chunks, ["name", "k"]).select("name", "u", (F.col("offset") + line_start(F.col("piece"), F.col("skip"), F.col("fresh"))).alias("place"))
    places = placed.groupBy("name").agg(F.map_from_entries(F.collect_set(F.struct("u", "place"))).alias("p"))
    place = lambda u: F.when(F.col(u) == F.col("n_lines"), F.col("n_chars")).otherwise(F.element_at("p", F.col(u)))
    full = drawn.join(places, "name", "left").withColumns({"a": place("u1"), "b": place("u2")})
    return full.select("name", "n_lines", "marked", F.least("a", "b").alias("first_cut"), F.greatest("a", "b").alias("second_cut"))


#: What ``fill_in_middle`` appends.
FIELDS = ("fim_lines", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output")


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 100, spm: int = 50, seed: int = 7, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """``df`` with fim_lines, fim_form, fim_prefix_chars, fim_middle_chars and fim_output; one row per row.

    A text of n lines (with their line ends; a last one may lack its) is cut at two line starts out of n + 1, end
    included, drawn by a hash of ``seed`` and the key.  Of a hundred documents ``rate`` are put together anew, of a
    hundred of these ``spm`` in the order suffix, prefix, middle, the others as prefix, suffix, middle, each part after its
    sentinel; the form is spm or psm.  All others are plain: as they were, with null sizes.  So are empty texts and those
    that hold a sentinel.

    Null texts are empty, null keys are drawn as the word null; rows equal in key and text are cut alike, and each stays.
    Very long texts are scanned by many tasks; each is a value of one row in the end, as it was before.  An empty
    table gives an empty result.  Columns of any name pass through; where ``df`` has one of these five names (in any
    case), the new column takes the name with an underscore after it.
    """
    own, names = fresh(df, *FIELDS), df.columns
    c = {n: f"c{k}" for k, n in enumerate(names)}
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(c[key]).cast("string"), F.lit("null"))).cast("binary"), 256)
    draw = lambda k: F.conv(F.substring(hexes, 8 * k + 1, 8), 16, 10).cast("long")
    base = df.toDF(*c.values()).withColumns({"h1": draw(0), "h2": draw(1), "h3": draw(2), "h4": draw(3), "text": F.coalesce(F.col(c[text]), F.lit(""))})
    base = base.withColumn("name", row_name(F.col(c[key]), F.col("text")))
    columns = [x for x in base.columns if x != "text"]
    short = _short(base.where(F.char_length("text") <= CHUNK).select(*columns, "text"), sentinels)
    at = lambda h: F.when(F.pmod(F.col(h), F.col("n_lines") + 1) == F.col("n_lines"), F.char_length("text")).otherwise(line_start(F.col("text"), F.pmod(F.col(h), F.col("n_lines") + 1), F.lit(True)))
    short = short.withColumns({"a": at("h1"), "b": at("h2")}).withColumns({"first_cut": F.least("a", "b").cast("long"), "second_cut": F.greatest("a", "b").cast("long")}).drop("a", "b")
    giant = base.where(F.char_length("text") > CHUNK)
    every = short.unionByName(giant.join(_long(giant, sentinels), "name"))
    plain = (F.col("text") == "") | F.col("marked") | (F.pmod("h3", F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod("h4", F.lit(100)) < spm, "spm").otherwise("psm")
    every = every.withColumn("form", form)
    part = lambda a, b: F.substring("text", a + F.lit(1), b - a)
    none, one, two, end = F.lit(0), F.col("first_cut").cast("int"), F.col("second_cut").cast("int"), F.char_length("text")
    prefix, middle, suffix = part(none, one), part(one, two), part(two, end)
    p, s, m = (F.lit(x) for x in sentinels)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    size = lambda x: F.when(F.col("form") != "plain", x)
    added = (F.col("n_lines"), F.col("form"), size(F.col("first_cut")), size(F.col("second_cut") - F.col("first_cut")), output)
    return every.select(*[F.col(x).alias(n) for n, x in c.items()], *[x.alias(n) for x, n in zip(added, own, strict=True)])


def restore(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text from which ``fill_in_middle`` made ``output``: no part holds a sentinel, so the first of each kind is a mark."""
    p, s, m = sentinels
    parts = {"psm": (p, s), "spm": (s, p)}

    def between(mark: str, after: str) -> Column:
        start = F.position(F.lit(mark), output) + len(mark)
        return F.substring(output, start, F.position(F.lit(after), output) - start)

    def joined(first: str, second: str) -> Column:
        prefix, suffix = (between(first, second), between(second, m)) if first == p else (between(second, m), between(first, second))
        middle = F.substring(output, F.position(F.lit(m), output) + len(m), F.char_length(output))
        return F.concat(prefix, middle, suffix)

    out = F.when(form == "plain", output)
    for name, order in parts.items():
        out = out.when(form == name, joined(*order))
    return out


def fim_digests(df: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of documents (doc_id, text)."""
    made = fill_in_middle(df.select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select(
        "doc_id", F.col("fim_lines").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        digest(F.col("fim_output")).alias("output_sha256"), digest(restore(F.col("fim_output"), F.col("fim_form"))).alias("restored_sha256"),
    )
