"""Language-model scores by a weighted backoff automaton.

A trigram model, each order smoothed by the next lower one with a Dirichlet prior:
p(w | h) = (c(h w) + PRIOR p(w | h')) / (c(h) + PRIOR), down to the smoothed unigrams.  As an automaton: a
state for every context of two words, one word, the start of a text and none (the root); an arc for
every n-gram seen in training, which carries its probability and leads to the longest context that
ends it; a failure arc from each state to that of its shorter context, which costs
PRIOR / (c(h) + PRIOR).  A text is read left to right once: a token takes the arc of the present state
if there is one, else failure arcs until there is (the root has an arc for every token).

The model is never gathered in one place.  Documents are dealt into parts (see ``parts``); a part asks
for the training counts of the distinct n-grams it holds, each n-gram by a 64-bit hash of its own, so
that no frequent context meets in one task, and builds the automaton of just these n-grams.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import ODD, cuts, deal, dealt_rows, pack_counts, pack_keys, part_count, part_of, unpack_counts, unpack_keys

ORDER = 3
#: Weight of the shorter context in counts, for contexts of one word and of two.
PRIORS = (64.0, 4.0)
#: Characters of a part; a part and the answers to it are in one task's memory.
PART_CHARS = 5_000_000
#: Bits of the name of an n-gram of two tokens or more: a chance of one in 10**7 that one of 7 * 10**9 others shares it.
NAME_BITS = 56
#: Tokens of a piece of a text; the pieces of a part are read side by side.
PIECE = 1024
END, START = 0xE0D, 0x57A27


def token_ids(text: str | None) -> np.ndarray:
    """XXH64 of each word of the text in lower-case A-Z, then the end token."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((*map(digest, words), END), np.uint64, len(words) + 1)


def is_training(doc_id) -> bool:
    """crc32(doc_id as text) mod 5 is not 1; a null id is training."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


def followed(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The name of an n-gram from that of its context and its last token."""
    with np.errstate(over="ignore"):
        h = (context ^ (context >> np.uint64(29))) * np.uint64(ODD) + token
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(64 - NAME_BITS)


class Part:
    """The tokens of the documents of one part and its distinct words and longer n-grams, by ascending name.

    ``word_of``: the word of each token; ``gram_of[k]``: the n-gram of k + 2 tokens that ends at it, -1 where the
    text is too young for one (the start of a text counts as a token of context).
    """

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        tokens = [token_ids(t) for t in texts]
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.train = np.array([is_training(i) for i in ids], bool)
        flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
        del tokens
        self.first = np.cumsum(self.length) - self.length
        at = np.arange(len(flat)) - np.repeat(self.first, self.length)
        trained = np.repeat(self.train, self.length)
        self.words, back = np.unique(flat, return_inverse=True)
        self.word_of = back.astype(np.int32)
        self.word_count = np.bincount(self.word_of, trained, len(self.words)).astype(np.int64)
        names, places = [], []
        context = np.empty(len(flat), np.uint64)
        for k in range(ORDER - 1):
            context[1:] = (names[-1] if names else flat)[:-1]
            if not k:
                context[self.first] = START
            names.append(followed(context, flat))
            places.append(np.nonzero(at >= k)[0].astype(np.int32))
        every = np.concatenate([n[p] for n, p in zip(names, places, strict=True)])
        own = np.concatenate([trained[p] for p in places])
        del names, context, flat, trained
        self.grams, first, back = np.unique(every, return_index=True, return_inverse=True)
        back = back.astype(np.int32)
        del every
        self.gram_count = np.bincount(back, own, len(self.grams)).astype(np.int64)
        cut = np.cumsum([len(p) for p in places])
        self.gram_of = np.full((ORDER - 1, len(at)), -1, np.int32)
        for k, p in enumerate(places):
            self.gram_of[k, p] = back[cut[k] - len(p) : cut[k]]
        # order and place of one occurrence of each n-gram
        self.order = np.searchsorted(cut, first, side="right").astype(np.int8)
        self.seen_at = np.concatenate(places)[first]


PACKET = "part int, bucket int, words binary, word_counts binary, grams binary, gram_counts binary"
ANSWER = "part int, bucket int, total long, types long, word_counts binary, gram_counts binary"


def names_of(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def part_rows(table: pa.Table) -> Part:
    docs = dealt_rows(table)
    return Part([], []) if docs is None else Part(docs.column(0).to_pylist(), docs.column(1).to_pylist())


def edges(part: Part, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the words and the longer n-grams of each bucket begin and end."""
    return cuts(part.words, buckets), cuts(part.grams, buckets, NAME_BITS)


def ask(table: pa.Table, buckets: int) -> pa.Table:
    """The packets of a part: one for every bucket, empty or not."""
    part, p = part_rows(table), table.column("part")[0].as_py()
    w, g = edges(part, buckets)
    pieces = [(slice(w[b], w[b + 1]), slice(g[b], g[b + 1])) for b in range(buckets)]
    columns = [
        [pack_keys(part.words[x]) for x, _ in pieces],
        [pack_counts(part.word_count[x]) for x, _ in pieces],
        [pack_keys(part.grams[y]) for _, y in pieces],
        [pack_counts(part.gram_count[y]) for _, y in pieces],
    ]
    return pa.table([pa.array([p] * buckets, pa.int32()), pa.array(range(buckets), pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=names_of(PACKET))


def answer(table: pa.Table) -> pa.Table:
    """Adds up one bucket over all parts and answers each of them, in its order."""
    out: dict[str, list] = {}
    totals = None
    for kind in ("word", "gram"):
        keys = [unpack_keys(b) for b in table.column(f"{kind}s").to_pylist()]
        sizes = [len(k) for k in keys]
        counts = [unpack_counts(b, n) for b, n in zip(table.column(f"{kind}_counts").to_pylist(), sizes, strict=True)]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)
        out[kind] = [pack_counts(x) for x in np.split(total[at], np.cumsum(sizes)[:-1])]
        if totals is None:
            totals = int(total.sum()), int((total > 0).sum())
    n = table.num_rows
    columns = [table.column("part"), table.column("bucket"), pa.array([totals[0]] * n, pa.int64()), pa.array([totals[1]] * n, pa.int64())]
    return pa.table([*columns, pa.array(out["word"], pa.binary()), pa.array(out["gram"], pa.binary())], names=names_of(ANSWER))


class BackoffAutomaton:
    """States, arcs and failure arcs over the words of one part, weights in log10.

    States: 0 the root, 1 the start of a text, then the words as contexts, then the n-grams as contexts.  The arcs of a
    state lie together, by word; the root's arc of a word is ``root[word]`` and leads to ``after[word]``.
    """

    def __init__(self, root: np.ndarray, after: np.ndarray, state: np.ndarray, word: np.ndarray, weight: np.ndarray, to: np.ndarray, failure: np.ndarray, shorter: np.ndarray):
        arcs = state * len(root) + word
        order = np.argsort(arcs, kind="stable")
        self.root, self.after = root, after
        self.arcs, self.word, self.weight, self.to = arcs[order], word[order], weight[order], to[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(state, minlength=len(failure)))]).astype(np.int32)
        self.failure, self.shorter = failure, shorter

    def find(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The arc of each (state, word), -1 where there is none."""
        first = self.begin[state]
        n = self.begin[state + 1] - first
        out = np.full(len(state), -1, np.int64)
        one = np.nonzero(n == 1)[0]
        hit = one[self.word[first[one]] == word[one]]
        out[hit] = first[hit]
        more = np.nonzero(n > 1)[0]
        if len(more):
            key = state[more] * len(self.root) + word[more]
            i = np.searchsorted(self.arcs, key)
            hit = self.arcs[np.minimum(i, len(self.arcs) - 1)] == key
            out[more[hit]] = i[hit]
        return out

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, next state) of one token of each text, from the state that each is in."""
        cost, end = np.zeros(len(state)), np.empty(len(state), np.int64)
        live, at, read = np.arange(len(state)), state, word
        while len(live):
            arc = self.find(at, read)
            hit = arc >= 0
            own, arc = live[hit], arc[hit]
            cost[own] += self.weight[arc]
            end[own] = self.to[arc]
            miss = ~hit
            live, at, read = live[miss], at[miss], read[miss]
            top = at == 0
            own = live[top]
            cost[own] += self.root[read[top]]
            end[own] = self.after[read[top]]
            down = ~top
            live, at, read = live[down], at[down], read[down]
            cost[live] += self.failure[at]
            at = self.shorter[at]
        return cost, end

    def traverse(self, words: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The log10 probability of each text (``words`` from ``first`` on), all read left to right side by side.

        Long texts are read in pieces; a piece is led in by the ORDER - 1 tokens before it, which is all that its
        first state can depend on.
        """
        n = -(-length // PIECE)
        text = np.repeat(np.arange(len(length)), n)
        piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        lead = np.where(piece > 0, ORDER - 1, 0)
        start = first[text] + piece * PIECE - lead
        size = np.minimum(PIECE, length[text] - piece * PIECE) + lead
        order = np.argsort(-size, kind="stable")
        text, start, size, lead = text[order], start[order], size[order], lead[order]
        state = np.where(lead > 0, 0, 1)
        total = np.zeros(len(size))
        for t in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -t))  # pieces longer than t
            cost, state[:m] = self.step(state[:m], words[start[:m] + t])
            total[:m] += np.where(t >= lead[:m], cost, 0.0)
        return np.bincount(text, total, len(length))


def automaton(part: Part, word_count: np.ndarray, gram_count: np.ndarray, total: int, types: int, texts: int) -> BackoffAutomaton:
    """The automaton of the n-grams of a part, from their counts in all training texts (of which there are ``texts``)."""
    n_words, n_grams = len(part.words), len(part.grams)
    root = (word_count + 0.5) / (total + 0.5 * (types + 1))
    known = np.nonzero(gram_count > 0)[0]
    order, at = part.order[known], part.seen_at[known]
    word = part.word_of[at].astype(np.int64)
    context = np.ones(len(known), np.int64)  # the start of a text
    begins = np.zeros(len(part.word_of), bool)
    begins[part.first] = True
    inner = ~begins[at]
    context[inner & (order == 0)] = part.word_of[at[inner & (order == 0)] - 1] + 2
    for k in range(1, ORDER - 1):
        mine = order == k
        context[mine] = part.gram_of[k - 1, at[mine] - 1] + 2 + n_words
    mass = np.concatenate([[0, texts], word_count, gram_count]).astype(np.float64)
    prior = np.concatenate([[1.0], np.full(1 + n_words, PRIORS[0]), np.asarray(PRIORS)[np.minimum(part.order + 1, ORDER - 2)]])
    shorter = np.zeros(2 + n_words + n_grams, np.int64)
    p = np.zeros(n_grams)
    for k in range(ORDER - 1):
        mine = order == k
        i, s, w = known[mine], context[mine], word[mine]
        lower = root[w] if not k else p[part.gram_of[k - 1, at[mine]]]
        p[i] = (gram_count[i] + prior[s] * lower) / (mass[s] + prior[s])
        # as a context, an n-gram fails to the one that lacks its first token
        shorter[i + 2 + n_words] = w + 2 if not k else part.gram_of[k - 1, at[mine]] + 2 + n_words
    last = order == ORDER - 2
    to = np.where(last, 0, known + 2 + n_words)
    to[last] = part.gram_of[ORDER - 3, at[last]] + 2 + n_words if ORDER > 2 else word[last] + 2
    after = np.where(word_count > 0, np.arange(n_words) + 2, 0)
    return BackoffAutomaton(np.log10(root), after, context, word, np.log10(p[known]), to, np.log10(prior / (mass + prior)), shorter)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_part(docs: pa.Table, answers: pa.Table, buckets: int, texts: int) -> pa.Table:
    """Scores the documents of a part with the answers of all buckets."""
    part = part_rows(docs)
    if answers.num_rows != buckets:
        raise ValueError("answers are missing")
    w, g = edges(part, buckets)
    word_count, gram_count = np.zeros(len(part.words), np.int64), np.zeros(len(part.grams), np.int64)
    total = types = 0
    for b, own_total, own_types, x, y in zip(*(answers.column(c).to_pylist() for c in ("bucket", "total", "types", "word_counts", "gram_counts")), strict=True):
        total, types = total + own_total, types + own_types
        word_count[w[b] : w[b + 1]] = unpack_counts(x, w[b + 1] - w[b])
        gram_count[g[b] : g[b + 1]] = unpack_counts(y, g[b + 1] - g[b])
    model = automaton(part, word_count, gram_count, total, types, texts)
    add = lambda x: np.add.reduceat(x, part.first)
    columns = [
        pa.array(part.ids, pa.int64()),
        pa.array(~part.train),
        pa.array(part.length),
        pa.array(add((word_count[part.word_of] > 0).astype(np.int64))),
        pa.array(np.full(len(part.ids), total, np.int64)),
        pa.array(add(model.root[part.word_of])),
        pa.array(model.traverse(part.word_of, part.first, part.length)),
    ]
    return pa.table(columns, names=names_of(RESULT))


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of RESULT per row of ``df``; the model learns from rows whose crc32(doc_id as text) mod 5 is not 1.

    Null texts are empty (one end token); rows with a null id are training rows; repeated rows count and
    are scored each; other columns are ignored; an empty table gives an empty result.  Counts cover all
    training rows; a text of any length is read whole.
    """
    learns = F.coalesce(F.pmod(F.crc32(F.col(key).cast("long").cast("string")), F.lit(5)) != 1, F.lit(True))
    sums = df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)), F.count("*"), F.count_if(learns)).first()
    buckets = part_count(sums[0] + sums[1], PART_CHARS)
    texts = sums[2]
    own = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = deal(own, part_of(buckets, F.col("doc_id"), F.col("text")))
    packets = dealt.groupBy("part").applyInArrow(lambda t: ask(t, buckets), PACKET)
    answers = packets.groupBy("bucket").applyInArrow(answer, ANSWER)
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda d, a: score_part(d, a, buckets, texts), RESULT)
