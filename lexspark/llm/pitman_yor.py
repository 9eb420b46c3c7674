"""Operator 3: a hierarchical Pitman-Yor language model, sampled and scored over the whole corpus.

A restaurant for each context (the word before) shares one parent, the restaurant of single
words, whose base is uniform over the V training words and one class of unknown words.
Customers are the training tokens. The seating of a restaurant matters only through the
number of tables that serve each word; a table is a customer of the parent.

Gibbs sampling goes through a restaurant in TURNS turns, word by word where it has no more
words of several customers, else by blocks of them: given the tables of the restaurant's
other words, the number of tables t for c customers of a word has probability in proportion
to S(c, t) prod_k (theta + d (T + k)) P(w), with generalised Stirling numbers S and the
parent's probability P. t is drawn from this for any c: up to FULL customers S comes from its
recursion, beyond from an integral (contour_ratio) between whose nodes is interpolated. After
BURN sweeps, SAMPLES more are averaged. While the contexts are sampled, the parent's
probabilities are the training frequencies; the parent is sampled on the tables of the
contexts' last sweep. A word's probability after context u is

    (c_uw - d t_uw) / (theta + c_u) + (theta + d T_u) / (theta + c_u) P(w)

with t_uw, T_u averaged over the samples, and of the same form for P(w). It sums to one.

Contexts and words after them are told apart by 32 hash bits each (two contexts may be one
restaurant by chance), words by 64. All counts are over all training documents:

1. chunks send word counts; buckets answer with corpus counts, N and V;
2. chunks send the distinct pairs of words with training counts and P(w); buckets hold whole
   restaurants, sample them, and answer with the counts and tables of each chunk's pairs;
3. chunks send each word's tables (each pair's from one chunk) and training count; buckets sample the parent;
4. chunks score their documents.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, mix64
from .exchange import CHUNK_BYTES, answer, bodies_by, bucket_edges, chunked, messages, pack, read_chunk, replies, resume, send, unpack
from .substring import SLICE_BYTES, distinct
from .words import WINDOW_BASE, blocks, word_hashes

#: Discount and strength of the context restaurants and of their parent.
DISCOUNT, STRENGTH = 0.75, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 10.0

BURN, SAMPLES = 2, 3
#: Turns of a sweep, between which the restaurants' totals are brought up to date.
TURNS = 8
#: Up to EXACT customers all numbers of tables are weighed at once.
EXACT = 24
#: Most customers in the table of Stirling numbers; nodes of a size above; words drawn at once.
FULL, NODES, DRAWN = 512, 401, 1 << 13

#: Stands for the end of a document, and for the context of its first word.
END = np.uint64(0x5EED0FD0C5E27D00)

FOLDS, HELD_OUT_FOLD = 5, 1


def log_stirling(discount: float, most: int) -> np.ndarray:
    """log S(c, t) for 1 <= t <= c <= most; S(c+1, t) = S(c, t-1) + (c - t d) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], np.log(np.maximum(c - t * discount, 0)) + out[c, t])
    return out


def contour_ratio(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t + 1) - log S(c, t) for c of hundreds and more and t + 1 <= c - 12, without a recursion.

    S(c, t) is c! / (t! d^t) times the coefficient of z^c in f(z)^t, f = 1 - (1 - z)^d. With
    z = exp(-x) that is an integral of exp(t log f + c x) over a curve around the cut x <= 0,
    here a hyperbola through the saddle, or through 1 / c if the saddle is nearer to 0.
    """
    c, t = c.astype(float)[:, None], t.astype(float)[:, None]
    log_y = lambda x: np.where(x.real > 0.7, np.log1p(-np.exp(-np.maximum(x.real, 0.7) - 1j * x.imag)), np.log(-np.expm1(-x)))  # noqa: E731  y = 1 - z
    log_f = lambda x: np.log(-np.expm1(discount * log_y(x)))
    slope = lambda x: discount * np.exp((discount - 1) * log_y(x).real - x - log_f(x).real)  # noqa: E731  of -log f
    low, high = np.full(c.shape, -90.0), np.full(c.shape, 4.0)  # log of the saddle
    for _ in range(60):
        middle = (low + high) / 2
        left = t * slope(np.exp(middle)) > c
        low, high = np.where(left, middle, low), np.where(left, high, middle)
    saddle = np.exp(low)
    start = np.maximum(saddle, 1 / c)
    bend = t * np.abs(slope(start * 1.001) - slope(start)) / (start * 0.001)
    scale = np.where(saddle < 4 / c, start, 1 / np.sqrt(np.maximum(bend, 1e-300)))
    tilt = np.where(start < 0.05, 0.4, 0.0)
    v = np.arange(0.02, 9, 0.04)
    x = start + scale * (1j * np.sinh(v) - tilt * (np.cosh(v) - 1))
    inside = (x.imag < np.pi) & (c * (start - x.real) < 700)
    step = scale * (1j * np.cosh(v) - tilt * np.sinh(v)) * inside
    x = np.where(inside, x, start)
    peak = t * log_f(start).real
    with np.errstate(over="ignore", under="ignore"):
        logs, grown = log_f(x), c * (x - start)
        # the integral of exp(c x) alone is nothing: for few tables it is left out, against cancellation
        few, level = t < c**discount, np.where(t < c**discount, 0, peak)
        part = lambda k: ((np.exp(grown + k * logs - level) - np.where(few, np.exp(grown), 0)) * step).imag.sum(1)
        return np.log(np.abs(part(t + 1) / part(t))) - np.log((t + 1) * discount)[:, 0]


class TableRatio:
    """log S(c, t + 1) - log S(c, t) for arrays of 1 <= t < c <= FULL * 2 ** doublings.

    Up to FULL customers from the recursion; above, linear between nodes of contour_ratio, four to
    a doubling of c and NODES over log(t / (c - t)). Against the recursion at up to 2,000 customers
    that errs by less than 0.001, but where all tables but 20 have one customer (up to 0.06).
    """

    def __init__(self, discount: float, doublings: int):
        logs = log_stirling(discount, FULL)
        with np.errstate(invalid="ignore"):
            self.small = np.nan_to_num(np.diff(logs, axis=1, append=-np.inf), nan=-np.inf, posinf=-np.inf)
        sizes = (FULL * 2.0 ** (np.arange(4 * doublings + 2) / 4)).astype(np.int64)
        self.large = np.zeros((len(sizes), NODES))
        for row, c in zip(self.large, sizes.tolist(), strict=True):
            place = np.linspace(-1, 1, NODES) * np.log(c - 1)
            t = np.unique(np.clip(np.round(c / (1 + np.exp(-place))), 1, c - 1).astype(np.int64))
            left = c - t
            ratio = np.log(left) - np.log(c * (c - 1.0) * (1 - discount) / 2)  # nearly all alone
            at = left > max(13, c**0.5 / 4)
            ratio[at] = contour_ratio(np.full(int(at.sum()), c), t[at], discount)
            row[:] = np.interp(place, np.log(t / left), ratio)

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        c, t = np.broadcast_arrays(c, t)
        out = self.small[np.minimum(c, FULL), np.minimum(t, FULL)]
        at = c > FULL
        if at.any():
            c, t = c[at].astype(float), t[at]
            i, x = np.divmod(4 * np.log2(c / FULL), 1)
            y = (np.log(t / (c - t)) / np.log(c - 1) + 1) / 2 * (NODES - 1)
            j = np.clip(y.astype(np.int64), 0, NODES - 2)
            y -= j
            first = i.astype(np.int64) * NODES + j
            flat = self.large.ravel()
            out[at] = (1 - x) * ((1 - y) * flat[first] + y * flat[first + 1]) + x * ((1 - y) * flat[first + NODES] + y * flat[first + NODES + 1])
        return out


#: Kept for the worker's next groups.
table_ratio = functools.lru_cache(8)(TableRatio)


def draw_tables(c: np.ndarray, rest: np.ndarray, p: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of words of more than EXACT customers, from the conditional.

    The weights rise to one top, found by halving, and are summed around it: all numbers over 6
    standard deviations to each side at least, or of a wide one 65 evenly spaced ones a quarter of a
    deviation apart, with an even place between (which adds a 192nd to the variance).
    """
    out = np.zeros(len(c), np.int64)
    ratio_of = table_ratio(discount, -(-(int(c.max()) // FULL).bit_length() // 4) * 4)

    def weighed(size, others, base, start, stride, n):
        t = start + stride * np.arange(n)
        at = np.clip(t, 1, size - 1)
        r = ratio_of(size, at) + np.log(strength + discount * (others + at)) + base
        weight = np.zeros(t.shape)
        np.cumsum(stride * (r[:, :-1] + r[:, 1:]) / 2 - (r[:, 1:] - r[:, :-1]) / 2, axis=1, out=weight[:, 1:])
        weight[(t < 1) | (t > size)] = -np.inf
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        k = (weight < rng.random((len(t), 1)) * weight[:, -1:]).sum(1)
        between = np.floor((rng.random(len(t)) - 0.5) * stride[:, 0] + 0.5).astype(np.int64)
        return np.clip(t[np.arange(len(t)), k] + between, 1, size[:, 0])

    for lo, hi in ((i, min(i + DRAWN, len(c))) for i in range(0, len(c), DRAWN)):
        size, others, base = c[lo:hi, None], rest[lo:hi, None], np.log(p[lo:hi, None])

        def rise(t, size=size, others=others, base=base):
            """log weight of t + 1 less that of t."""
            return ratio_of(size, t) + np.log(strength + discount * (others + t)) + base

        low, high = np.ones_like(size), size.copy()
        while (low < high).any():
            middle = np.minimum((low + high) // 2, size - 1)
            up = (rise(middle) > 0) & (low < high)
            low, high = np.where(up, middle + 1, low), np.where(up, high, np.minimum(high, middle))
        near = np.maximum(low // 8, 1)
        a, b = np.clip(low - near, 1, size - 1), np.clip(low + near, 1, size - 1)
        fall = (rise(a) - rise(b)) / np.maximum(b - a, 1)
        spread = 1 / np.sqrt(np.maximum(fall, 1e-18))
        stride = np.clip(np.ceil(spread / 4), 1, np.maximum(size // 32, 1)).astype(np.int64)
        narrow = spread[:, 0] < 2
        for at, reach, n in ((narrow, 12, 25), (~narrow, 32, 65)):
            start = np.where(stride == 1, np.maximum(low - reach, 1), low - reach * stride)
            out[lo:hi][at] = weighed(size[at], others[at], base[at], start[at], stride[at], n)
    return out


def sample_tables(c: np.ndarray, group: np.ndarray, total: np.ndarray, own: np.ndarray, p: np.ndarray, discount: float, strength: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One sweep: new tables for words of c customers, given ``total`` tables per group and the words' ``own``."""
    t = np.minimum(c, 1)
    rest = np.maximum(total[group] - own, 0)
    for n in np.unique(c[(c > 1) & (c <= EXACT)]).tolist():
        at = np.flatnonzero(c == n)
        k = np.arange(n)
        weight = np.cumsum(np.log((strength + discount * (rest[at, None] + k)) * p[at, None]), 1) + stirling[n, 1 : n + 1]
        weight += rng.gumbel(size=weight.shape)
        t[at] = weight.argmax(1) + 1
    more = np.flatnonzero(c > EXACT)
    if len(more):
        t[more] = draw_tables(c[more], rest[more], p[more], discount, strength, rng)
    return t


def sample_restaurants(c: np.ndarray, group: np.ndarray, p: np.ndarray, seed: int, discount: float = DISCOUNT, strength: float = STRENGTH, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(tables summed over SAMPLES sweeps, tables of the last sweep) per word; ``group`` numbers the restaurants, in order.

    The words of a restaurant take TURNS turns in a sweep and see the tables of the turns before, so
    one of up to TURNS words is sampled word by word; in a larger one words of one turn don't see each other.
    ``scale`` is how many times the whole restaurant is larger than the part given here.
    """
    rng, stirling = np.random.default_rng(seed), log_stirling(discount, EXACT)
    t, kept = np.minimum(c, 1), np.zeros(len(c), np.int64)
    groups = int(group.max()) + 1 if len(group) else 0
    total = np.bincount(group, t, minlength=groups) * scale
    open_ = np.flatnonzero(c > 1)  # the others have no choice
    mine = group[open_]
    first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])[: len(mine)])
    turn = (np.arange(len(mine)) - np.repeat(first, np.diff(np.append(first, len(mine))))) % TURNS
    turns = [open_[turn == k] for k in range(TURNS)]
    for sweep in range(BURN + SAMPLES):
        for at in turns:
            if len(at):
                new = sample_tables(c[at], group[at], total, t[at], p[at], discount, strength, stirling, rng)
                total += np.bincount(group[at], new - t[at], minlength=groups) * scale
                t[at] = new
        if sweep >= BURN:
            kept += t
    return kept, t


def distinct_places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, sorted; the place of each value among them), by one sort."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(values)]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


class ChunkTokens:
    """Token hashes of a chunk's documents, an end after each, and which are training tokens."""

    def __init__(self, ids: list[int | None], texts: list[bytes], held_out: list[bool]):
        parts, counts = [], []
        for lo, hi in blocks([len(t) for t in texts], SLICE_BYTES):
            hashes, bounds = word_hashes(texts[lo:hi], lower=True)
            parts.append(np.insert(hashes, bounds[1:], END))
            counts.append(np.diff(bounds) + 1)
        self.words = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.lengths = np.concatenate([*counts, np.zeros(0, np.int64)])
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)])
        self.doc_of = np.repeat(np.arange(len(texts)), self.lengths)
        self.train = ~np.array(held_out, bool)[self.doc_of]
        self.kinds, self.kind = distinct_places(self.words)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(each token's pair code; distinct codes; each token's place among them; a token of each code)."""
        before = np.concatenate([[END], self.words[:-1]])  # a document's first word follows the end of the one before
        code = (mix64(before) & np.uint64(0xFFFFFFFF00000000)) | (mix64(before * WINDOW_BASE + self.words) >> np.uint64(32))
        kinds, place = distinct_places(code)
        example = np.zeros(len(kinds), np.int64)
        example[place] = np.arange(len(code))
        return code, kinds, place, example


def by_bucket(answers: pa.Table, n_buckets: int) -> list[list[np.ndarray] | None]:
    found = {b: unpack(body) for b, body in bodies_by(answers, "bucket").items()}
    return [found.get(b) for b in range(n_buckets)]


def gathered(parts: list[list[np.ndarray] | None], i: int) -> np.ndarray:
    return np.concatenate([p[i] for p in parts if p is not None])


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chunks: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Tokens are lower-cased (A-Z) words and one end. Documents whose crc32 of the id as
    text leaves 1 modulo 5 are held out; the rest train the model. A null text is empty
    (its end alone is scored); a null id counts as the text "". Rows that repeat count
    each. ``score`` and ``base_score`` are log10 probabilities of the whole text; the
    perplexity of a text is 10 ** (-score / n_tokens). ``train_tokens`` is N.
    """
    n_chunks = n_chunks or chunk_count(docs, CHUNK_BYTES, text)
    chunks = chunked(docs, n_chunks, doc_id, text)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    chunks = chunks.withColumn("held_out", fold == HELD_OUT_FOLD)

    def tokens_of(table: pa.Table) -> tuple[int, list, list[bool], ChunkTokens]:
        chunk, ids, texts = read_chunk(table)
        folds = dict(zip(table.column("doc_id").to_pylist(), table.column("held_out").to_pylist(), strict=True))
        held_out = [folds[i] for i in ids]
        return chunk, ids, held_out, ChunkTokens(ids, texts, held_out)

    def dealt(chunk: int, code: np.ndarray, *columns: np.ndarray, every: list[np.ndarray] = []) -> pa.Table:  # noqa: B006
        """Messages of each bucket's part of the columns, and of ``every`` whole."""
        edges = bucket_edges(code, n_chunks, 64).tolist()
        return messages(chunk, {b: pack(code[i:j], *(c[i:j] for c in columns), *every) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i})

    def kind_of(answers: pa.Table, kind: int) -> pa.Table:
        return answers.filter(pa.array([k == kind for k in answers.column("kind").to_pylist()], pa.bool_()))

    def send_words(table: pa.Table) -> pa.Table:
        chunk, _, _, own = tokens_of(table)
        return dealt(chunk, own.kinds, np.bincount(own.kind[own.train], minlength=len(own.kinds)).astype(np.uint32))

    def sums(sent: dict[int, list[np.ndarray]], i: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes of all messages, sum of their i-th column)."""
        every = np.concatenate([s[0] for s in sent.values()])
        kinds = distinct(every)
        return kinds, np.bincount(np.searchsorted(kinds, every), np.concatenate([s[i] for s in sent.values()]), len(kinds)).astype(np.int64)

    def count_words(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        sent = {c: unpack(body) for c, body in bodies_by(table, "chunk").items()}
        kinds, counts = sums(sent, 1)
        totals = np.array([counts.sum(), (counts > 0).sum()], np.int64)
        # every chunk needs the totals, whether it asked or not
        return replies(bucket, {c: pack(counts[np.searchsorted(kinds, sent[c][0])] if c in sent else counts[:0], totals) for c in range(n_chunks)})

    def word_counts(answers: pa.Table) -> tuple[np.ndarray, int, int]:
        parts = by_bucket(answers, n_chunks)
        totals = np.sum([p[1] for p in parts if p is not None], 0)
        return gathered(parts, 0), int(totals[0]), int(totals[1])

    def send_pairs(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return messages(0, {})
        chunk, _, _, own = tokens_of(table)
        counts, n, v = word_counts(answers)
        _, kinds, place, example = own.pairs()
        seen = np.bincount(place[own.train], minlength=len(kinds)).astype(np.uint32)
        # the parent's probability in eighths of a binary order: seating needs no more
        p = (counts[own.kind[example]] + 0.5) / (n + 0.5 * (v + 1))
        totals = np.array([n, v], np.int64)
        return dealt(chunk, kinds, seen, np.clip(np.round(-8 * np.log2(p)), 0, 255).astype(np.uint8), every=[totals])

    def sample_contexts(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        sent = {c: unpack(body) for c, body in bodies_by(table, "chunk").items()}
        kinds, counts = sums(sent, 1)
        p = np.zeros(len(kinds))
        owner = np.full(len(kinds), -1, np.int64)
        for c, (code, seen, rank, _) in reversed(sent.items()):
            at = np.searchsorted(kinds, code)
            p[at] = 2.0 ** (rank / -8)
            owner[at[seen > 0]] = c
        context = kinds >> np.uint64(32)
        group = np.cumsum(np.append(False, context[1:] != context[:-1]))
        kept, last = sample_restaurants(counts, group, p, seed=bucket)
        customers, tables = np.bincount(group, counts).astype(np.int64), np.bincount(group, kept).astype(np.int64)
        out = {}
        for c, (code, *_, totals) in sent.items():
            at = np.searchsorted(kinds, code)
            mine = group[at][np.append(True, group[at][1:] != group[at][:-1])]
            out[c] = pack(counts[at].astype(np.uint32), kept[at].astype(np.uint32), np.where(owner[at] == c, last[at], 0).astype(np.uint32), customers[mine], tables[mine], totals)
        return replies(bucket, out)

    def send_tables(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return messages(0, {})
        chunk, _, _, own = tokens_of(table)
        _, kinds, _, example = own.pairs()
        contexts = by_bucket(answers, n_chunks)
        totals = next(p[5] for p in contexts if p is not None)
        per_word = np.bincount(own.kind[example], gathered(contexts, 2), len(own.kinds)).astype(np.uint32)
        # the training counts go along again: their buckets' first answers aren't computed once more for the score
        seen = np.bincount(own.kind[own.train], minlength=len(own.kinds)).astype(np.uint32)
        return dealt(chunk, own.kinds, per_word, seen, every=[totals])

    def sample_parent(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        sent = {c: unpack(body) for c, body in bodies_by(table, "chunk").items()}
        kinds, customers = sums(sent, 1)
        _, counts = sums(sent, 2)
        n_words = next(iter(sent.values()))[3]
        v = max(int(n_words[1]), 1)
        here = max(int((customers > 0).sum()), 1)
        # words are dealt by hash, so this bucket's share of the restaurant is like the rest
        kept, _ = sample_restaurants(customers, np.zeros(len(kinds), np.int64), np.full(len(kinds), 1 / (v + 1)), bucket, PARENT_DISCOUNT, PARENT_STRENGTH, max(v / here, 1.0))
        totals = np.array([customers.sum(), kept.sum()], np.int64)
        out = {}
        for c in range(n_chunks):
            at = np.searchsorted(kinds, sent[c][0]) if c in sent else np.zeros(0, np.int64)
            out[c] = pack(customers[at], kept[at], totals, counts[at], n_words)
        return replies(bucket, out)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds_of = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds_of, strict=True)})
        _, ids, held_out, own = tokens_of(table)
        pairs, parent = by_bucket(kind_of(answers, 0), n_chunks), by_bucket(kind_of(answers, 1), n_chunks)
        counts, (n, v) = gathered(parent, 3), next(p[4] for p in parent if p is not None).tolist()
        base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
        customers, kept = gathered(parent, 0), gathered(parent, 1) / SAMPLES
        everyone = np.sum([p[2] for p in parent if p is not None], 0)
        unseen = (PARENT_STRENGTH + PARENT_DISCOUNT * everyone[1] / SAMPLES) / (v + 1)
        p_word = (customers - PARENT_DISCOUNT * kept + unseen) / (PARENT_STRENGTH + everyone[0])
        _, kinds, place, example = own.pairs()
        context = kinds >> np.uint64(32)
        group = np.cumsum(np.append(False, context[1:] != context[:-1]))
        seats, tables = gathered(pairs, 3)[group], gathered(pairs, 4)[group] / SAMPLES
        p = gathered(pairs, 0) - DISCOUNT * gathered(pairs, 1) / SAMPLES + (STRENGTH + DISCOUNT * tables) * p_word[own.kind[example]]
        logs = np.log10(p / (STRENGTH + seats))[place]
        heads = own.bounds[:-1]
        per_doc = lambda x: np.add.reduceat(x, heads)  # noqa: E731  every document has its end
        columns = [ids, held_out, own.lengths, per_doc((counts > 0)[own.kind].astype(np.int64)), np.full(len(ids), n), per_doc(base[own.kind]), per_doc(logs)]
        return pa.table({name: pa.array(c, t) for name, c, t in zip(names, columns, kinds_of, strict=True)})

    tagged = lambda df, kind: df.withColumn("kind", F.lit(kind))
    words = answer(send(chunks, send_words), count_words)
    contexts = answer(resume(chunks, words, send_pairs), sample_contexts)
    parent = answer(resume(chunks, contexts, send_tables), sample_parent)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return resume(chunks, tagged(contexts, 0).unionByName(tagged(parent, 1)), score, schema)
