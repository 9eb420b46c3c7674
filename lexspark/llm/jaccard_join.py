"""Operator 7: Jaccard similarity join of shingle sets by parity sketches.

A document's set of word shingles is hashed into a bit sketch, each shingle flipping one
bit. The Hamming distance of two sketches is at most the size of the symmetric difference
of the sets. Sets whose similarity reaches t and whose sizes are a <= b have b <= a / t and
differ in at most a (1 - t) / t shingles; with sizes in bands whose edges grow by 1 / t, a
band and the next are joined as one group under one bound D. A group's sketches are cut
into B > D words of WIDE bits: a pair within the bound has at least B - D equal words
(pigeonhole), a word being joined on as a hash of the places of its bits. B - D is above the number of a
document's empty words as a rule, and then only words with content need to be joined;
documents with as many empty words as that join on them too.

Equal sets are one class, joined through its least member. Pairs that meet in small buckets
are counted, and only those that meet as often as a link needs are verified on the exact sets. A
pair that also shares a large bucket needs no such count: in a large bucket, where many near copies
meet, sketches folded to few bits (parities too, so their distance bounds the difference as well) are compared, and only pairs leave it that the distance
allows, that lie in different components, and that a spanning forest needs: fewer than the bucket
has members. They are verified, components grow, and this is done again, at last with every pair of
different components that the distance allows. So no link that would join two components is
lost, and a group of n near copies sends out about n pairs a round, not n squared. Buckets of
over BLOCK members are compared in blocks: first each block by itself, and of a document's buckets only the
largest, then with the bucket's first block, at last, in the buckets that still hold several
components, the blocks outside the largest component with all. So no task holds a whole bucket, and a group that is one component after the first
rounds is never compared block by block.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, free_name, materialize, mix64, scratch
from .components import connected_components
from .exchange import FILTER_BITS, answer, bodies_by, bucket_edges, chunked, messages, pack, read_chunk, replies, resume, send, trimmed, unpack
from .substring import SLICE_BYTES, among, distinct, more_than_once
from .words import blocks, windows, word_hashes

#: Buckets of at most so many members are compared pair by pair; larger ones by sketches,
#: in blocks of at most so many.
SMALL_BUCKET = 6
BLOCK = 1024

#: Bits of a sketch word, for sketches of fewer than 2 ** 32 bits in all, and of a larger one's.
WIDE, NARROW = 1024, 64

#: Bits of the folded sketch for each shingle of the bound: enough that sets whose similarity is 0.015 below
#: the least are told apart by their distance there.
FOLDED = 16

#: Classes, and buckets, with more than this share of all rows: 1 / HOT_SHARE of them at most, which are
#: broadcast, so their rows stay where they are.
HOT_SHARE = 1 / 1000

#: Most keys of buckets that are broadcast (8 bytes each).
BROADCAST_KEYS = 100_000

#: UTF-8 bytes of a chunk: its text, sets, keys and their answers are held together, about ten bytes for each of the text.
SET_CHUNK_BYTES = 6 << 20

#: Rows that a chunk hands back at a time, and words of two sketches that are compared at a time.
KEPT_ROWS, COMPARED = 512, 1 << 20

#: Stands for a missing id among longs.
NO_ID = -(2**63)


@functools.cache
def band_edges(percent: int, most: int) -> tuple[int, ...]:
    """Edges of the size bands up to over ``most``: a set and one of at most 1 / t times its size are at most a band apart."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * 100 // percent + 1)
    return tuple(edges)


def group_bound(group: int, percent: int, edges: tuple[int, ...]) -> int:
    """D: the most shingles in which a pair whose smaller set is in band ``group`` may differ."""
    return (edges[group + 1] - 1) * (100 - percent) // percent


def sketches(hashes: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(group, shared keys that any partner needs, join keys, sketch words) for a set's own band's group and the one below.

    A partner has at least B - D equal words; those that aren't empty are at least B - D
    less the set's own empty words.
    """
    n = len(hashes)
    if not n:
        return []
    edges = band_edges(percent, 1 << (2 * n).bit_length())
    band = int(np.searchsorted(edges, n, "right")) - 1
    out = []
    for group in (band, band - 1):
        bound = group_bound(group, percent, edges) if group >= 0 else 0
        if not bound:  # no two different sets can link
            continue
        spare = 2 + bound // 6
        words = bound + spare
        wide = WIDE if words * WIDE < 1 << 32 else NARROW
        place = (hashes >> np.uint64(32)) * np.uint64(words * wide) >> np.uint64(32)  # sorted as the hashes are
        heads = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        if len(heads) < n:
            place = place[heads[np.diff(np.append(heads, n)) % 2 == 1]]
        word = place // np.uint64(wide)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
        sums = np.add.reduceat(mix64(place + np.uint64(1)), first) if len(first) else place
        salt = mix64(np.arange(words, dtype=np.uint64) + np.uint64(group << 32))
        filled = word[first].astype(np.int64)
        empty = words - len(filled)
        if empty < spare:
            keys = mix64(sums ^ salt[filled])
        else:
            keys = mix64(salt)
            keys[filled] = mix64(sums ^ salt[filled])
        bits = -(-FOLDED * bound // 64) * 64
        folded = np.bincount(((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64), minlength=bits) & 1
        out.append((group, max(1, spare - empty), keys >> np.uint64(64 - FILTER_BITS), np.packbits(folded.astype(np.uint8)).view(np.uint64)))
    return out


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; a shorter text is one shingle, one without words none."""
    out: list[np.ndarray] = []
    for lo, hi in blocks([len(t) for t in texts], SLICE_BYTES):
        words, bounds = word_hashes(texts[lo:hi], lower=True)
        every = windows(words, shingle)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = every[a : b - shingle + 1] if b - a >= shingle else windows(words[a:b], b - a) if b > a else every[:0]
            out.append(distinct(own))
    return out


GROUP = "struct<grp: int, need: int, keys: array<long>, words: binary>"
SETS = f"doc_id long, n long, fingerprint binary, groups array<{GROUP}>, body binary"


def sketched_sets(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str, n_chunks: int | None = None) -> DataFrame:
    """One row per document: set size, fingerprint of the set, and where it can have partners its keys, how many must be shared, and the set.

    Two steps of :mod:`.exchange`: a chunk sends its distinct keys, a bucket answers with
    a bit for each, whether another document has it. A document with fewer such keys than
    any partner would share keeps none.
    """
    n_chunks = n_chunks or chunk_count(docs, SET_CHUNK_BYTES, text)
    chunks = chunked(docs, n_chunks, doc_id, text)

    def keys_of(table: pa.Table) -> tuple[int, list, list[np.ndarray], list[list[tuple]]]:
        chunk, ids, texts = read_chunk(table)
        sets = shingle_sets(texts, shingle)
        return chunk, ids, sets, [sketches(s, percent) for s in sets]

    def all_of(found: list[list[tuple]]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(keys for own in found for _, _, keys, _ in own)])

    def offer(table: pa.Table) -> pa.Table:
        chunk, _, _, keys = keys_of(table)
        every = all_of(keys)
        kinds = distinct(every)
        twice = among(kinds, more_than_once(every))
        edges = bucket_edges(kinds, n_chunks, FILTER_BITS).tolist()
        return messages(chunk, {b: pack(kinds[i:j], twice[i:j]) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i})

    def meet(table: pa.Table) -> pa.Table:
        bucket, bodies = table.column("bucket")[0].as_py(), bodies_by(table, "chunk")
        sent = {c: unpack(body) for c, body in bodies.items()}
        met = distinct(np.concatenate([more_than_once(np.concatenate([s[0] for s in sent.values()])), *(s[0][s[1]] for s in sent.values())]))
        return replies(bucket, {c: pack(among(s[0], met)) for c, s in sent.items()})

    def keep(table: pa.Table, answers: pa.Table) -> pa.Table:
        group_type = pa.struct([("grp", pa.int32()), ("need", pa.int32()), ("keys", pa.list_(pa.int64())), ("words", pa.binary())])
        kinds_of = [pa.int64(), pa.int64(), pa.binary(), pa.list_(group_type), pa.binary()]
        schema = pa.schema(list(zip(["doc_id", "n", "fingerprint", "groups", "body"], kinds_of, strict=True)))
        batches: list[pa.RecordBatch] = []
        if table.num_rows:
            _, ids, sets, keys = keys_of(table)
            kinds = distinct(all_of(keys))
            bits = [unpack(body)[0] for body in bodies_by(answers, "bucket").values()]
            met = kinds[np.concatenate(bits)] if bits else kinds[:0]
            for lo in range(0, len(ids), KEPT_ROWS):
                rows: list[tuple] = []
                for i in range(lo, min(lo + KEPT_ROWS, len(ids))):
                    own, mine = sets[i], keys[i]
                    sets[i] = keys[i] = None  # a set is held once: in the sets, then packed
                    groups = []
                    for group, need, every, sketch in mine:
                        shared = every[among(every, met)]
                        if len(shared) >= need:
                            groups.append({"grp": group, "need": need, "keys": shared.astype(np.int64), "words": sketch.tobytes()})
                    rows.append((ids[i], len(own), hashlib.md5(own.tobytes()).digest(), groups or None, pack(own) if groups else None))
                batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_of, strict=True)], schema=schema))
        return pa.Table.from_batches(batches, schema)

    return resume(chunks, answer(send(chunks, offer), meet), keep, SETS)


def verify(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs``, a written table, whose sets (rep, body) reach the threshold, as a written table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    own = bodies.join(ids, "rep", "left_semi")
    with_both = pairs.join(own.select(F.col("rep").alias("a"), F.col("body").alias("x")), "a").join(own.select(F.col("rep").alias("b"), F.col("body").alias("y")), "b")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):  # one pair's sets at a time
                both = np.concatenate([unpack(x.as_py())[0], unpack(y.as_py())[0]])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(with_both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")


def counted_pairs(small: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b) that meet in small buckets (key, grp, rep) as often as a link of theirs needs, and whose sizes allow one.

    What is shuffled is a count for each pair, not their keys.
    """
    met = small.select("key", "grp", F.col("rep").alias("a")).join(small.select("key", F.col("rep").alias("b")), "key").filter(F.col("a") < F.col("b"))
    shared = met.groupBy("grp", "a", "b").agg(F.count("*").alias("shared"))
    # only what the other side can't change: a pair that meets less often than either needs goes early
    of = lambda c: groups.select("grp", F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("need").alias(f"x{c}"))
    with_a = shared.join(of("a"), ["grp", "a"]).filter(F.col("shared") >= F.col("xa")).select("grp", "a", "b", "shared", "na")
    both = with_a.join(of("b"), ["grp", "b"]).filter(F.col("shared") >= F.col("xb"))
    return both.filter((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))).select("a", "b").distinct()


def spread_join(rows: DataFrame, sizes: DataFrame, total: int, on: list[str], size: str = "size") -> DataFrame:
    """``rows`` joined with the ``sizes`` of their keys; keys of over HOT_SHARE of the ``total`` rows, a bounded few, by broadcast."""
    hot = sizes.filter(F.col(size) > total * HOT_SHARE)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(sizes.filter(F.col(size) <= total * HOT_SHARE), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def bucket_pairs(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(grp, key, a, b) from gatherings: rows (grp, key, block, side, rep, comp, n, words), pairs of different components within the distance.

    Members of side 1 are only compared with side 2, those of side 0 with all. With ``forest``, the nearest pairs that join a block's components, one less than there
    are at most.
    """

    def compare(table: pa.Table) -> pa.Table:
        rep, comp, n, side = (table.column(c).to_numpy() for c in ("rep", "comp", "n", "side"))
        words = np.stack([np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()])
        names, comp = np.unique(comp, return_inverse=True)
        # the largest component's members are only compared with the others
        counts = np.bincount(comp)
        order = np.argsort(comp == counts.argmax(), kind="stable")
        rep, comp, n, side, words = rep[order], comp[order], n[order], side[order], words[order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, COMPARED // max(1, words.size))
        for at in range(0, len(rep) - int(counts.max()), step):
            own = slice(at, min(at + step, len(rep) - int(counts.max())))
            distance = np.bitwise_count(words[own, None] ^ words[None, at:]).sum(2, dtype=np.int64)
            near = distance * (100 + percent) <= (n[own, None] + n[None, at:]) * (100 - percent)
            near &= comp[own, None] != comp[None, at:]
            near &= (side[own, None] != side[None, at:]) | (side[own, None] == 0)
            i, j = np.nonzero(near)
            later = i < j
            found.append((i[later] + at, j[later] + at, distance[i[later], j[later]]))
        i, j, distance = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        if forest:
            label = list(range(len(names)))

            def root(x: int) -> int:
                while label[x] != x:
                    label[x] = x = label[label[x]]
                return x

            keep = []
            for k in np.argsort(distance, kind="stable").tolist():
                x, y = root(int(comp[i[k]])), root(int(comp[j[k]]))
                if x != y:
                    label[x] = y
                    keep.append(k)
            i, j = i[keep], j[keep]
        of = lambda c: pa.array(np.full(len(i), table.column(c)[0].as_py(), np.int64))
        return trimmed(pa.table({"grp": of("grp").cast(pa.int32()), "key": of("key"), "a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])}))

    return rows.groupBy("grp", "key", "block").applyInArrow(compare, "grp int, key long, a long, b long")


def gatherings(large: DataFrame) -> DataFrame:
    """(grp, key, rep, size) from members (grp, rep, lead) of large buckets: the buckets of one lead as one gathering named by it, each member once.

    Near copies share most of their buckets, and those have one lead, the member of least hash, or
    a few. So a document is in a few gatherings, not in one for each key, and two that share a bucket meet.
    """
    gathered = materialize(large.select("grp", F.col("lead").alias("key"), "rep").distinct(), "gatherings")
    sizes = materialize(gathered.groupBy("grp", "key").agg(F.count("*").alias("size")), "gathering-sizes")
    return spread_join(gathered, sizes, sizes.agg(F.sum("size")).first()[0] or 0, ["grp", "key"])


def blocks_of(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def split_gatherings(named: DataFrame) -> DataFrame:
    """(grp, key, main, mains, rests) of the gatherings in ``named`` (grp, key, rep, size, comp) with several components: the largest, its blocks and those of all others."""
    counts = named.groupBy("grp", "key", "comp").agg(F.count("*").alias("n"))
    shares = counts.groupBy("grp", "key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "comp")).alias("top"))
    rest = F.col("members") - F.col("top.n")
    return shares.filter(rest > 0).select("grp", "key", F.col("top.comp").alias("main"), blocks_of(F.col("top.n")).alias("mains"), blocks_of(rest).alias("rests"))


def dealt_to_first(members: DataFrame, own_only: bool) -> DataFrame:
    """``members`` (grp, key, rep, size, comp), once for each ``block`` they are compared in: their own, or also each with the first."""
    dealt = members.withColumn("_n", blocks_of(F.col("size"))).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int"))
    others = F.array("_own")
    if not own_only:
        others = F.when(F.col("_own") == 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array(F.lit(0)))
    dealt = dealt.withColumn("_other", F.explode(others))
    return dealt.withColumn("block", F.least("_own", "_other") * F.col("_n") + F.greatest("_own", "_other")).withColumn("side", F.lit(0))


def dealt_to_all(members: DataFrame) -> DataFrame:
    """``members`` (grp, key, rep, comp, main, mains, rests), once for each ``block`` they are compared in, and the ``side`` they have there.

    The largest component is cut into blocks by itself, the rest into others, and only blocks of
    the rest meet all: beside n near copies of one component, m others are n rows for each block
    of the m, and m rows for each block of the n, not all of them for each block.
    """
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("rep"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    # blocks of the rest are numbered before those of the largest component; with the first of these a block of the rest is also compared in itself
    dealt = members.withColumn("_width", F.col("mains") + F.col("rests")).withColumn("_own", F.when(is_main, own + F.col("rests")).otherwise(own))
    others = F.when(is_main, F.sequence(F.lit(0), F.col("rests") - 1)).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("_width") - 1), F.col("_own")))
    dealt = dealt.withColumn("_other", F.explode(others))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(high == F.col("rests"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    return dealt.withColumn("block", low * F.col("_width") + high).withColumn("side", side)


def link_components(sets: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """(node, comp) over sets (rep, n, groups), a written table, that meet in buckets."""
    groups = sets.select("rep", "n", F.inline("groups"))
    keys = groups.select("rep", "grp", F.explode(F.array_distinct("keys")).alias("key"))
    lead = F.min(F.struct(F.xxhash64("rep").alias("hash"), "rep"))["rep"]
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), lead.alias("lead"))
    sizes = materialize(sizes.filter(F.col("size") > 1), "bucket-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    members = materialize(spread_join(keys, sizes, total, ["key"]), "bucket-members")
    small = members.filter(F.col("size") <= SMALL_BUCKET).select("key", "grp", "rep")
    tested = materialize(counted_pairs(small, groups.select("rep", "grp", "n", "need"), percent), "pairs")
    labels = connected_components(verify(tested, bodies, percent))
    large = members.filter(F.col("size") > SMALL_BUCKET)
    if not large.limit(1).count():
        return labels
    large = materialize(gatherings(large), "gathered-members")
    place = ["grp", "key"]
    best = large.groupBy("rep").agg(F.max(F.struct("size", *place)).alias("best")).select("rep", "best.grp", "best.key")
    fruitful = None
    for step in ("own block", "first block", "all blocks"):
        some = large.join(best, ["rep", *place], "left_semi") if step == "own block" else large
        if fruitful is not None:  # a gathering of one block that had no pair is done: components only grow
            some = some.filter(F.col("size") > BLOCK).unionByName(some.filter(F.col("size") <= BLOCK).join(fruitful, place, "left_semi"))
        named = some.join(labels, some.rep == labels.node, "left").select(*place, "rep", "size", F.coalesce("comp", "rep").alias("comp"))
        named = materialize(named, "named-members")
        split = materialize(split_gatherings(named), "split-gatherings")
        n_split = split.count()
        if not n_split:
            if step == "own block":
                continue
            break
        split = F.broadcast(split) if n_split <= BROADCAST_KEYS else split
        if step == "all blocks":
            dealt = dealt_to_all(named.join(split, place))
        else:
            open_ = materialize(named.join(split, place, "left_semi"), "open-members")
            dealt = dealt_to_first(open_, step == "own block")
            if step == "first block":  # for the same reason a gathering of one component is done
                large = open_.select(*place, "rep", "size")
        rows = dealt.join(groups.select("rep", "grp", "n", "words"), ["rep", "grp"]).select(*place, "block", "side", "rep", "comp", "n", "words")
        near = materialize(bucket_pairs(rows, percent, forest=step != "all blocks"), "near-pairs")
        if step == "first block":
            fruitful = near.select(*place).distinct()
        found = materialize(near.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if not found.limit(1).count():
            continue
        labels = connected_components(verify(found, bodies, percent), labels)
        tested = tested.unionByName(found)
    return labels


def similar_documents(docs: DataFrame, shingle: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, as a written table.

    Documents link when 100 x intersection >= ``percent`` x union of their sets of
    distinct ``shingle``-word windows of lower-cased (A-Z) words; a shorter document is one
    shingle, its whole sequence. ``component_id`` is the least id that links lead to, the
    own one included. Null and blank texts have no shingles and link with nothing. Rows
    that repeat an id count as documents of one name; a null id stays null and stands
    before all others, so whatever links with it has the component null. A very long text is one set.
    """
    with scratch(docs.sparkSession):
        return materialize(_similar(docs, shingle, percent, doc_id, text), "components", keep=True)


def _similar(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str) -> DataFrame:
    table = materialize(sketched_sets(docs, shingle, percent, doc_id, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), "sketched-sets")
    filled = table.filter(F.col("n") > 0)
    classes = materialize(filled.groupBy("n", "fingerprint").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    # ids may repeat; only then is a set named by a hash of its id and fingerprint
    repeated = table.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    name = F.col("doc_id") if not repeated else F.xxhash64("doc_id", "fingerprint")
    met = table.filter(F.col("body").isNotNull()).withColumn("rep", name)
    chosen = classes.select(F.col("n").alias("cn"), F.col("fingerprint").alias("cf"), F.col("rep").alias("least"))
    own = (F.col("doc_id") == F.col("least")) & (F.col("n") == F.col("cn")) & (F.col("fingerprint") == F.col("cf"))
    narrow = met.select("doc_id", "rep", "n", "fingerprint", "groups").join(chosen, own, "left_semi").dropDuplicates(["rep"])
    sets = materialize(narrow, "sketches")
    bodies = met.select("rep", "body") if not repeated else met.dropDuplicates(["rep"]).select("rep", "body")
    labels = link_components(sets.select("rep", "n", "groups"), bodies, percent)
    # from names back to ids: a component is called by its least id
    named = sets.join(labels, sets.rep == labels.node).select(F.col("doc_id").alias("id"), "n", "fingerprint", "comp")
    lowest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    linked = named.join(lowest, "comp").select(F.col("n").alias("ln"), F.col("fingerprint").alias("lf"), "component_id")
    by_class = classes.join(linked, (classes.n == linked.ln) & (classes.fingerprint == linked.lf), "left")
    by_class = materialize(by_class.select("n", "fingerprint", "size", F.coalesce("component_id", "rep").alias("component_id")), "class-components")
    total = by_class.agg(F.sum("size")).first()[0] or 0
    rows = spread_join(filled.select("doc_id", "n", "fingerprint"), by_class, total, ["n", "fingerprint"])
    blank = table.filter(F.col("n") == 0).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = rows.select("doc_id", "n", "component_id").unionByName(blank)
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, columns unchanged, whatever their names: the row of the least id.

    A null id stands before all others. Where ids repeat, each row counts as a document of its
    own, and of a group's rows of the least id one stays, the first by a digest of its text.
    Null and blank texts are linked with nothing and stay; a very long text is one set.
    """
    with scratch(docs.sparkSession):
        return _first_of_each(docs, shingle, percent, doc_id, text)


def _first_of_each(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str) -> DataFrame:
    number = F.col(doc_id).cast("long")
    if not docs.groupBy(number).count().filter(F.col("count") > 1).limit(1).count():
        found = similar_documents(docs, shingle, percent, doc_id, text)
        name = free_name(docs, "_gone")
        gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
        return docs.join(materialize(gone, "duplicates", keep=True), number.eqNullSafe(F.col(name)), "left_anti")
    # written, so that a row has one number throughout; the row itself is one column, clear of any name
    order = F.struct(F.coalesce(number, F.lit(NO_ID)).alias("id"), F.sha2(F.col(text), 256).alias("text"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), order.alias("_place"), F.monotonically_increasing_id().alias("_number"))
    rows = materialize(rows, "numbered-rows", keep=True)
    found = similar_documents(rows, shingle, percent, "_number", "_text")
    placed = found.select(F.col("doc_id").alias("_number"), "component_id").join(rows.select("_number", "_place"), "_number")
    kept = placed.groupBy("component_id").agg(F.min(F.struct("_place", "_number")).alias("least")).select("least._number")
    return rows.join(materialize(kept, "kept-rows", keep=True), "_number", "left_semi").select("_row.*")
