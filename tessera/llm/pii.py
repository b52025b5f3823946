"""Personal data by a skip-chain conditional random field.

Base rules find what can be told from the characters alone.  The field labels candidate tokens (those with a
digit or an @; all other words have no other label than "none", so they separate chains) as e-mail, address, card,
phone or none.  Its potentials are those of a token's features, of tokens next to each other, and of skip links
between tokens of one document, however distant, that are written alike or are similar: a number in the
form that the rules know makes the same number elsewhere in the document one too.  Tokens inside base spans
are observed; loopy belief propagation carries what they say along chains and links.

A group of m tokens that are alike has at most 2 m links (to the one before and to the first), so that no two
are further than two links apart.  The potentials are learnt from the base spans by the likelihood of each token
given its neighbours, on a bounded sample of tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Emitter, arrow_schema, fresh, materialize, rows

KINDS = ("email", "ip", "card", "phone")
NONE, LABELS = len(KINDS), len(KINDS) + 1

# --- base rules: fixed values, the patterns of the four kinds ---
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

#: Bound of the training sample: tokens of each label, lowest hash first.
TRAIN_TOKENS = 6000
#: Buckets of hashed features, and features of a token.
BUCKETS, SLOTS = 4096, 9
EPOCHS, RATE, L2 = 150, 0.15, 2e-5
#: Rounds of message passing, share of a message that is kept from the round before, least belief of an added span.
ROUNDS, DAMPING, SURE = 12, 0.3, 0.9
#: Least length of a token's letters and digits for a link, from which it counts as a long one, and digits that similar numbers share.
LINKED, LONG, SHARED = 3, 6, 7
#: Kinds of potentials of two tokens: next to each other, alike and short, alike and long, similar.
CHAIN, SHORT, SAME, SIMILAR = range(4)
#: Log potential that equal labels have by each of these kinds before anything is learnt: alike tokens tend to one label.
PRIOR = (0.0, 0.5, 2.0, 1.5)
#: What may lie between two tokens next to each other, and the characters of tokens.
GAP = re.compile(r"[\x20().-]{0,3}")
CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@()-")
REST = re.compile(r"[A-Za-z0-9._%+@()-]*")
SEED = re.compile(r"[0-9@]")
EDGE = "._%-()@"
RUNS = re.compile(r"[0-9]+|[A-Za-z]+")
BEFORE, AFTER = re.compile(r"([^\W\d_]+)[^\w]*\Z"), re.compile(r"[^\w]*([^\W\d_]+)")
#: Characters around a token in which the words before and after it are looked for.
AROUND = 32

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    d = digits_of(text)
    return CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d)


def is_phone(text: str) -> bool:
    return PHONE_DIGITS[0] <= len(digits_of(text)) <= PHONE_DIGITS[1]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from each @, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the rules' matches, by start and kind; offsets are code points."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for kind, pattern, good in ((1, IP, is_ip), (2, CARD, is_card), (3, PHONE, is_phone)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if good(m.group())]
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- tokens, features and links ---


@dataclass
class Token:
    start: int
    end: int
    text: str
    label: int | None  # the base span's kind, None outside of them


def tokens(text: str, spans: list[Span]) -> list[Token]:
    """The candidate tokens of a text, in order, without punctuation at their edges."""
    out, done, s = [], 0, 0
    by_start = sorted(spans)
    m = SEED.search(text)
    while m:
        start = m.start()
        while start > done and text[start - 1] in CHARACTERS:
            start -= 1
        end = REST.match(text, m.start()).end()
        done = end
        a, b = start, end
        while a < b and text[a] in EDGE and not (text[a] == "(" and ")" in text[a + 1 : b]):
            a += 1
        while b > a and text[b - 1] in EDGE + "+" and not (text[b - 1] == ")" and "(" in text[a:b]):
            b -= 1
        if a < b:
            while s < len(by_start) and by_start[s][1] <= a:
                s += 1
            inside = [x for x in by_start[s : s + 4] if x[0] < b and x[1] > a]
            out.append(Token(a, b, text[a:b], inside[0][2] if inside else None))
        m = SEED.search(text, end)
    return out


def features(text: str, t: Token) -> list[int]:
    """SLOTS buckets: the token's shapes, sizes, what rules out a kind, and the words around it."""
    d = digits_of(t.text)
    before, after = BEFORE.search(text[max(0, t.start - AROUND) : t.start]), AFTER.match(text[t.end : t.end + AROUND])
    refuted = ("luhn" if CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and len(d) == len(t.text) and not luhn(d) else "") + ("octet" if t.text.count(".") == 3 and IP.fullmatch(t.text) and not is_ip(t.text) else "")
    told = (
        "s" + RUNS.sub(lambda m: ("9" if m.group()[0] in "0123456789" else "a") + str(len(m.group())), t.text),
        "p" + RUNS.sub(lambda m: "9" if m.group()[0] in "0123456789" else "a", t.text),
        f"d{len(d)}/{min(len(t.text) - len(d), 3)}",
        f"c{t.text.count('@')}{t.text.count('.')}{t.text.count('-')}",
        "b" + (before.group(1).lower() if before else ""), "a" + (after.group(1).lower() if after else ""),
        "f" + (text[t.start - 1 : t.start] if t.start else "") + ("9" if t.text[0] in "0123456789" else t.text[0] if t.text[0] in "+(" else "a"),
        "r" + refuted, "",
    )
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in told]


def keys(t: Token) -> list[tuple[int, str]]:
    """Under which names a token meets those that are alike or similar."""
    plain = "".join(c for c in t.text.lower() if c.isalnum())
    out = []
    if len(plain) >= LINKED:
        out.append((SAME if len(plain) >= LONG else SHORT, plain))
    if "@" in t.text:
        out.append((SIMILAR, t.text.lower().rpartition(".")[0]))
    elif plain.isdigit() and len(plain) > SHARED:
        out.append((SIMILAR, plain[-SHARED:]))
    return out


def links(text: str, found: list[Token], at: int = 0) -> list[tuple[int, int, int]]:
    """(earlier, later, kind of potential) of the tokens of one document, numbered from ``at``."""
    out = [(at + i - 1, at + i, CHAIN) for i in range(1, len(found)) if (m := GAP.fullmatch(text, found[i - 1].end, found[i].start)) is not None and m.end() >= m.start()]
    first: dict[tuple[int, str], int] = {}
    last: dict[tuple[int, str], int] = {}
    alike: dict[int, set[int]] = {}
    for i, t in enumerate(found):
        for key in keys(t):
            if key in first:
                for j in {first[key], last[key]}:
                    if j not in alike.get(i, ()):  # one link of two tokens, the strongest kind comes first
                        alike.setdefault(i, set()).add(j)
                        out.append((at + j, at + i, key[0]))
            first.setdefault(key, i)
            last[key] = i
    return out


# --- learning and inference ---


@dataclass(frozen=True)
class Field:
    """Log potentials: of features (BUCKETS, LABELS), and of two tokens (4, LABELS, LABELS), earlier token first."""

    single: np.ndarray
    pair: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        return cls(np.zeros((BUCKETS, LABELS)), np.array(PRIOR)[:, None, None] * np.eye(LABELS))

    def beliefs(self, feature: np.ndarray, observed: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """(tokens, LABELS) marginals by ROUNDS of loopy belief propagation; ``observed`` is -1 where there is no label.

        Every graph of a batch is passed at once; messages follow edges only, so documents don't meet.
        """
        own = self.single[feature].sum(axis=1)
        own = np.where((observed >= 0)[:, None], np.where(np.arange(LABELS) == observed[:, None], 0.0, -40.0), own - _logsum(own))
        if not len(edges):
            return np.exp(own - _logsum(own))
        n, m = len(own), len(edges)
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        potential = np.concatenate([self.pair[edges[:, 2]], self.pair[edges[:, 2]].transpose(0, 2, 1)])  # source label first
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        message = np.zeros((2 * m, LABELS))
        slot = target[:, None] * LABELS + np.arange(LABELS)

        def gathered() -> np.ndarray:
            return own + np.bincount(slot.ravel(), message.ravel(), n * LABELS).reshape(n, LABELS)

        for _ in range(ROUNDS):
            sent = gathered()[source] - message[back]
            new = _logsum(sent[:, :, None] + potential, 1)[:, 0]
            message = DAMPING * message + (1 - DAMPING) * (new - _logsum(new))
        out = gathered()
        return np.exp(out - _logsum(out))


def _logsum(x: np.ndarray, axis: int = 1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))


def fit(label: np.ndarray, feature: np.ndarray, around: np.ndarray) -> Field:
    """Potentials of largest pseudo-likelihood, with a normal prior around the blank field, by full-batch Adam.

    ``around`` (tokens, 2 x 4 x LABELS): how many neighbours of each label a token has by each kind of potential, earlier ones first.
    Labels weigh alike up to the square root of their frequency; links are learnt symmetric but for the chain.
    """
    if not len(label) or len(set(label.tolist())) < 2:
        return Field.blank()
    share = np.bincount(label, minlength=LABELS)
    weight = 1 / np.sqrt(np.maximum(share, 1))[label]
    weight /= weight.sum()
    n, wide = len(label), BUCKETS * LABELS
    blank = np.concatenate([Field.blank().single.ravel(), Field.blank().pair.ravel()])
    theta = blank.copy()
    half = around.shape[1] // 2
    early, late = around[:, :half].reshape(n, 4, LABELS), around[:, half:].reshape(n, 4, LABELS)
    slot = feature[:, :, None] * LABELS + np.arange(LABELS)
    target = np.eye(LABELS)[label]
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def tied(pair: np.ndarray) -> np.ndarray:
        out = pair.copy()
        out[1:] = (pair[1:] + pair[1:].transpose(0, 2, 1)) / 2
        return out

    for step in range(1, EPOCHS + 1):
        single, pair = theta[:wide].reshape(BUCKETS, LABELS), tied(theta[wide:].reshape(4, LABELS, LABELS))
        z = single[feature].sum(axis=1) + np.einsum("nka,kab->nb", early, pair) + np.einsum("nkb,kab->na", late, pair)
        g = (np.exp(z - _logsum(z)) - target) * weight[:, None]
        g_single = np.bincount(slot.ravel(), np.repeat(g[:, None], SLOTS, 1).ravel(), wide)
        g_pair = np.einsum("nka,nb->kab", early, g) + np.einsum("nkb,na->kab", late, g)
        grad = np.concatenate([g_single, tied(g_pair).ravel()]) + L2 * (theta - blank)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:wide].reshape(BUCKETS, LABELS), tied(theta[wide:].reshape(4, LABELS, LABELS)))


def examples(text: str) -> Iterator[tuple[int, list[int], list[int]]]:
    """(label, features, neighbours by kind and label) of every candidate token; without a base span it is none."""
    found = tokens(text, base_spans(text))
    label = [NONE if t.label is None else t.label for t in found]
    early, late = np.zeros((len(found), 4, LABELS), np.int32), np.zeros((len(found), 4, LABELS), np.int32)
    for i, j, kind in links(text, found):
        early[j, kind, label[i]] += 1
        late[i, kind, label[j]] += 1
    for i, t in enumerate(found):
        yield label[i], features(text, t), [*early[i].ravel().tolist(), *late[i].ravel().tolist()]


def train(docs: DataFrame, text: str = "text") -> Field:
    """The field learnt from the base spans of ``docs``; of each label at most TRAIN_TOKENS tokens, by a hash of their text and place, go to the driver."""
    kinds = arrow_schema(label=pa.int32(), turn=pa.int64(), feature=pa.list_(pa.int32()), around=pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = Emitter(kinds)
            for (whole,) in zip(*rows(batch, "text"), strict=True):
                if not whole or not SEED.search(whole):
                    continue
                name = xxhash.xxh64_intdigest(whole.encode("utf-8", "surrogatepass"))
                for i, example in enumerate(examples(whole)):
                    e.add(example[0], xxhash.xxh64_intdigest(i.to_bytes(8, "little"), name) - (1 << 63), *example[1:])
                    if e.full():
                        yield e.take()
            yield e.take()

    seen = docs.select(F.col(text).alias("text")).mapInArrow(run, "label int, turn long, feature array<int>, around array<int>")
    seen = materialize(seen.dropDuplicates(["label", "turn"]), "tokens")  # a token of equal texts counts once
    sample = None
    for k in range(LABELS):
        part = seen.where(F.col("label") == k).orderBy("turn").limit(TRAIN_TOKENS)
        sample = part if sample is None else sample.unionByName(part)
    told = sample.toArrow()  # at most LABELS x TRAIN_TOKENS rows of fixed size
    order = np.lexsort((told.column("turn").to_numpy(), told.column("label").to_numpy()))
    matrix = lambda c, width: np.array(told.column(c).combine_chunks().flatten().to_numpy(), np.int64).reshape(-1, width)[order]
    return fit(told.column("label").to_numpy()[order].astype(np.int64), matrix("feature", SLOTS), matrix("around", 8 * LABELS).astype(np.float64))


def plausible(kind: int, text: str) -> bool:
    """What an added span must have at least: its kind's signs, or enough digits."""
    d = len(digits_of(text))
    return (text.count("@") == 1 and d < len(text) - 1, bool(IP.fullmatch(text)), d >= CARD_DIGITS[0] - 2, PHONE_DIGITS[0] - 3 <= d <= PHONE_DIGITS[1])[kind]


def added_spans(text: str, found: list[Token], joined: set[int], belief: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, belief) of runs of unobserved tokens of one kind; ``joined``: tokens next to the one before.

    Numbers may have several tokens; the least sure one counts.
    """
    out: list[list] = []
    last = -2
    for i, t in enumerate(found):
        kind = int(belief[i].argmax())
        if t.label is not None or kind == NONE or belief[i, kind] < SURE:
            continue
        p = float(belief[i, kind])
        if last == i - 1 and i in joined and kind >= 2 and out[-1][2] == kind:
            out[-1][1], out[-1][3] = t.end, min(out[-1][3], p)
        else:
            out.append([t.start, t.end, kind, p])
        last = i
    return [tuple(s) for s in out if plausible(s[2], text[s[0] : s[1]])]


def spans_of(texts: list[str | None], field: Field) -> list[list[tuple[int, int, int, bool, float]]]:
    """(start, end, kind, base, belief) of each text, by start and kind; one graph for all of them."""
    base, found, graph, observed, feature, size = [], [], [], [], [], 0
    for text in texts:
        text = text or ""
        base.append(base_spans(text) if SEED.search(text) else [])
        own = tokens(text, base[-1])
        if any(t.label is None for t in own):
            graph.append(links(text, own, size))
            observed += [-1 if t.label is None else t.label for t in own]
            feature += [features(text, t) for t in own]
            size += len(own)
        else:  # nothing to tell
            own = []
            graph.append([])
        found.append(own)
    flat = np.array([x for g in graph for x in g], np.int64).reshape(-1, 3)
    belief = field.beliefs(np.array(feature, np.int64).reshape(-1, SLOTS), np.array(observed, np.int64), flat)
    out, at = [], 0
    for text, spans, own, edges in zip(texts, base, found, graph, strict=True):
        joined = {j - at for _, j, kind in edges if kind == CHAIN}
        new = added_spans(text or "", own, joined, belief[at : at + len(own)])
        at += len(own)
        out.append(sorted([(a, b, k, True, 1.0) for a, b, k in spans] + [(a, b, k, False, p) for a, b, k, p in new], key=lambda s: (s[0], s[2], s[1])))
    return out


#: Tokens and characters of documents whose graphs are passed at once.
TEXTS, CHARS = 256, 1 << 24
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,belief:double>>"


def find_personal_data(df: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``df`` with a column ``name`` of type SPANS: what the rules find and what the field adds, by start and kind; one row per row.

    Offsets are code points, ends exclusive.  Base spans always stay; an added span holds no token that touches one.
    Null and empty texts have no spans; a text of any length is read whole, in memory that grows with the text and the
    number of its candidate tokens.  Spans depend on the text alone, given the field, so repeated rows have the same; without
    any base span in the table nothing is learnt and nothing is added.  An empty table gives an empty result.  Columns of
    any name pass through; a column called like ``name`` in any case stays, and the new one takes the name with an underscore.
    """
    field = train(df, text)
    model = df.sparkSession.sparkContext.broadcast(field)  # BUCKETS x LABELS numbers and four small tables
    (own,) = fresh(df, name)
    names, n = df.columns, len(df.columns)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("belief", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, held, chars = [], [], 0
            for t in batch.column(n).to_pylist():
                held.append(t)
                chars += len(t or "")
                if len(held) >= TEXTS or chars >= CHARS:
                    told += spans_of(held, model.value)
                    held, chars = [], 0
            told += spans_of(held, model.value)
            values = [[{"kind": KINDS[k], "start": a, "end": b, "base": base, "belief": p} for a, b, k, base, p in spans] for spans in told]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(values, kind)], [*names, own])

    schema = StructType([*df.schema.fields, StructField(own, StructType.fromDDL(f"x {SPANS}")[0].dataType)])
    return df.select("*", F.col(text)).toDF(*[f"c{k}" for k in range(n + 1)]).mapInArrow(run, schema)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and digest of the base spans, all spans as text."""
    found = find_personal_data(df.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
