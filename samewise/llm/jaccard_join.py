"""N-gram Jaccard self-join as a T-occurrence search with divided lists.

A document's shingles are ordered by how common they are, by a count-min sketch over all documents, then
by hash. Two sets of sizes n and m with a Jaccard similarity of t share at least T = t / (1 + t) * (n + m)
shingles, so they share one among the n - ceil(t * n) + 1 rarest of either: with the T - 1 longest
inverted lists set aside, one occurrence in the short lists makes a candidate. More precisely, all they share
among those is what they share beyond the ceil(t * max(n, m)) - 1 others, so the number of short lists a pair
is in has to reach T less that; for sets of about one size this is a tenth of the set. The inverted index of the short lists is
spread over the cluster by shingle; each of its tasks collapses the lists of the same members into one row with their number. These rows
meet by their least member, where the lists that two documents share are counted, and the counts are summed: lists of one group of
documents have few different least members, so a pair is counted in few places, however many lists it shares. A candidate is held
against its query by bitmaps of a few bits a shingle first; if those don't rule it out, it is searched with its query's
whole set, whose shingles' inverted lists over the candidates are divided: a heap merges
the short ones, and candidates that can still reach T are probed for in the long ones by binary search.

Short lists of over ``PAIRED`` documents are not paired at once, nor counted. Their members are first tested against one of
them; then some of those outside the largest class of a list are tested against its other classes, more of them in
each of several bounded rounds, until every pair of the list is tested or known to be of one class. So a group of thousands of near
copies costs a few tests a document, and no link between classes is lost. Before a test, a pair is met once, in the first list
that both are open in, and a bitmap of every set bounds how much two sets differ: each shingle flips one of its bits, so bits that
differ are at most as many as shingles that only one set has.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.shingles import fingerprint, halves, mixed, shingle_sets
from samewise.operators.components import components
from samewise.operators.shared import arrow_rows, dropped, small, written

#: Similarity that links, in hundredths.
HUNDREDTHS = 75
#: Counters of the sketch are 2 to this power, whatever the input: 4 MB a task, 1 MB broadcast.
SKETCH_BITS = 20
#: Longest list whose members are all paired in its own task.
PAIRED = 32
#: Candidates of one query that are searched together.
CHUNK = 256
#: Members of a list, outside its largest class, that are tested against its other classes in the second round, and the factor to the next.
DRAWN, GROWTH = 16, 32
#: Postings that a task gathers before it writes them out.
UNIT = 1 << 19
#: Sets that a task remembers, so that copies in other units of it add nothing.
REMEMBERED = 1 << 20
#: Words of 64 bits in the bitmap of a set.
BITMAP_WORDS = 8
#: Bits of an outline for each shingle, at least.
OUTLINE_BITS = 4
#: Pairs of members that a task counts at once, beyond one batch.
COUNTED = 1 << 20


def overlap_needed(n: int, m, hundredths: int = HUNDREDTHS):
    """The least overlap with which sets of sizes n and m are similar enough."""
    return -(-hundredths * (n + m) // (100 + hundredths))


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], hundredths: int = HUNDREDTHS) -> list[int]:
    """The places of the candidates whose sets are similar enough to the query's. All sets are sorted and distinct."""
    sizes = np.array([len(c) for c in candidates], np.int64)
    need = overlap_needed(len(query), sizes, hundredths)
    possible = np.flatnonzero(need <= np.minimum(len(query), sizes))
    if not len(possible) or not len(query):
        return []
    # inverted lists of the query's shingles over the candidates, each in ascending order of candidate
    keys = np.concatenate([candidates[i] for i in possible])
    owners = np.repeat(possible, sizes[possible])
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    at = np.minimum(np.searchsorted(query, keys), len(query) - 1)
    of, owners = at[query[at] == keys], owners[query[at] == keys]
    if not len(of):
        return []
    lo, hi = np.searchsorted(of, np.arange(len(query)), "left"), np.searchsorted(of, np.arange(len(query)), "right")
    length = hi - lo
    least = int(need[possible].min())
    longest = max(2, int(length.max()))
    # how many lists are worth setting aside: all but what one occurrence needs for short ones, fewer for long ones
    aside = min(least - 1, int(least / (0.0085 * np.log2(longest)) + 1))
    by_length = np.argsort(-length, kind="stable")
    long, short = by_length[:aside], by_length[aside:]
    seen: dict[int, int] = {}
    for owner in heapq.merge(*(owners[lo[k] : hi[k]].tolist() for k in short.tolist() if length[k])):
        seen[owner] = seen.get(owner, 0) + 1
    near = np.array([c for c, n in seen.items() if n + len(long) >= need[c]], np.int64)
    # binary probes of the long lists, which lie one after another in the index
    index = of * len(candidates) + owners
    probes = long[:, None] * len(candidates) + near
    at = np.minimum(np.searchsorted(index, probes), len(index) - 1)
    total = (index[at] == probes).sum(0) + np.array([seen[c] for c in near.tolist()], np.int64)
    return near[total >= need[near]].tolist()


def _needed(n: str, m: str, hundredths: int) -> str:
    """SQL for how many short lists a pair of sets of sizes n and m has to be in."""
    return f"(ceil({hundredths} * ({n} + {m}) / {100 + hundredths}) - ceil({hundredths} * greatest({n}, {m}) / 100) + 1)"


def _sketch(docs: DataFrame) -> np.ndarray:
    """The binary order of magnitude of each counter, over the shingles of all documents."""
    cells, parts = 1 << SKETCH_BITS, 64

    def count(batches):
        import pyarrow as pa

        table = np.zeros(cells, np.int64)
        for b in batches:
            sets = list(shingle_sets(b.column(0)))
            if sets:
                table += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
        if table.any():
            rows = np.minimum(table, 0xFFFFFFFF).astype("<u4").reshape(parts, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["part", "counts"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(x.as_py(), "<u4").astype(np.int64)
                sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.frexp(v.astype(float))[1].astype("u1").tobytes()], pa.binary())], ["part", "magnitudes"])

    counted = docs.select("text").mapInArrow(count, "part int, counts binary")
    rows = counted.repartition(parts, "part").mapInArrow(add, "part int, magnitudes binary").collect()  # a fixed number of bytes
    out = np.zeros((parts, cells // parts), np.uint8)
    for r in rows:
        out[r.part] = np.frombuffer(r.magnitudes, "u1")
    return out.ravel()


def _signed(docs: DataFrame, taken: frozenset) -> DataFrame:
    """(doc_id, n_shingles, sig, check) for every document."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = list(shingle_sets(b.column(1)))
            both = [halves(s) for s in sets]
            sig = [y if x in taken else x for x, y in both]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.int64()), pa.array([x ^ y for x, y in both], pa.int64())], ["doc_id", "n_shingles", "sig", "check"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig long, check long")


def _told_apart(docs: DataFrame) -> tuple[DataFrame, frozenset]:
    """The written table of ``_signed`` in which no two sets share a number, and the numbers that two sets would have shared.

    Of a billion documents, less than one pair shares a number by chance.
    """
    taken: frozenset = frozenset()
    while True:
        signed = written(_signed(docs, taken), "signed")
        seen = signed.groupBy("sig").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("sig")
        if not (shared := frozenset(r.sig for r in seen.collect())) - taken:
            return signed, taken
        dropped(signed)
        taken |= shared


def _short_lists(docs: DataFrame, magnitudes: np.ndarray, buckets: int, hundredths: int, taken: frozenset) -> DataFrame:
    """(bucket, payload): the postings of the short lists, a payload for each bucket and unit of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(magnitudes)

    def unit(sigs: list, sizes: list, prefixes: list):
        import pyarrow as pa

        hashes = np.concatenate(prefixes)
        docs_ = np.repeat(np.arange(len(sigs)), [len(p) for p in prefixes])
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        hashes, docs_, bucket = hashes[order], docs_[order], bucket[order]
        sig, size = np.array(sigs, "<i8"), np.array(sizes, "<u4")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        names, cells = [], []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            own = docs_[i:j]
            head = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            d = own[head]
            many = np.diff(np.concatenate([head, [j - i]])).astype("<u4")
            names.append(int(bucket[i]))
            cells.append(np.array([len(d)], "<u8").tobytes() + sig[d].tobytes() + size[d].tobytes() + many.tobytes() + hashes[i:j].astype("<u8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(cells, pa.binary())], ["bucket", "payload"])

    def run(batches):
        kind = shared.value
        seen: set[int] = set()
        sigs, sizes, prefixes, held = [], [], [], 0
        for b in batches:
            for s in shingle_sets(b.column(0)):
                if not len(s) or (sig := fingerprint(s, taken)) in seen:
                    continue
                seen.add(sig)
                keep = len(s) - -(-hundredths * len(s) // 100) + 1
                rare = np.argsort(kind[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:keep]
                sigs.append(sig)
                sizes.append(len(s))
                prefixes.append(s[rare])
                held += keep
            if held >= UNIT:
                yield unit(sigs, sizes, prefixes)
                sigs, sizes, prefixes, held = [], [], [], 0
                if len(seen) >= REMEMBERED:
                    seen = set()
        if held:
            yield unit(sigs, sizes, prefixes)

    return docs.select("text").mapInArrow(run, "bucket int, payload binary")


def _merge_lists(hundredths: int):
    """The function of the index's tasks: the members of short lists, a row for lists of the same ones, and the members of lists too long for it."""

    def lists(payloads: list[bytes]):
        sig, size, key = [], [], []
        for p in payloads:
            d = int(np.frombuffer(p, "<u8", 1)[0])
            many = np.frombuffer(p, "<u4", d, 8 + 12 * d)
            sig.append(np.repeat(np.frombuffer(p, "<i8", d, 8), many))
            size.append(np.repeat(np.frombuffer(p, "<u4", d, 8 + 8 * d), many))
            key.append(np.frombuffer(p, "<u8", -1, 8 + 16 * d))
        sig, size, key = np.concatenate(sig), np.concatenate(size).astype(np.int64), np.concatenate(key)
        order = np.argsort(key, kind="stable")
        sk = key[order]
        twin = np.zeros(len(sk), bool)
        twin[1:] = sk[1:] == sk[:-1]
        twin[:-1] |= twin[1:].copy()
        order = order[twin]
        sig, size, key = sig[order], size[order], key[order]
        order = np.lexsort((sig, size, key))
        sig, size, key = sig[order], size[order], key[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        return sig[fresh], size[fresh], key[fresh]

    def merge(payloads):
        import pyarrow as pa

        sig, size, key = lists(payloads)
        if not len(sig):
            return
        # members of a list on two sides of a gap that no link spans are in lists of their own
        cut = np.ones(len(key), bool)
        cut[1:] = (key[1:] != key[:-1]) | (100 * size[:-1] < hundredths * size[1:])
        edge = np.flatnonzero(cut)
        many = np.diff(np.append(edge, len(key)))
        names = ["list", "sig", "size", "members", "sizes", "lists"]
        big = np.repeat(many > PAIRED, many)
        if big.any():
            none, n = pa.nulls(int(big.sum()), pa.list_(pa.int64())), pa.nulls(int(big.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key[big].view("<i8")), pa.array(sig[big]), pa.array(size[big]), none, none, n], names)
        short = (many > 1) & (many <= PAIRED)
        if not short.any():
            return
        own = np.repeat(short, many)
        sig, size, many = sig[own], size[own], many[short]
        edge = np.cumsum(many) - many
        # lists of the same members, told apart by 128 bits, are one row
        turned = mixed(sig.view("<u8"))
        one, two = np.add.reduceat(turned, edge), np.add.reduceat(mixed(turned + np.uint64(1)), edge)
        order = np.lexsort((two, one, many))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(many[order]) != 0) | (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        head = order[new]
        alike = np.diff(np.append(np.flatnonzero(new), len(order)))
        ends = np.concatenate([[0], np.cumsum(many[head])])
        at = np.repeat(edge[head] - ends[:-1], many[head]) + np.arange(ends[-1])
        rows = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[at], pa.int64())) for x in (sig, size)]
        none = pa.nulls(len(head), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(np.minimum.reduceat(sig, edge)[head]), none, *rows, pa.array(alike, pa.int64())], names)

    def run(batches):
        now, held = None, []
        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != now and held:
                    yield from merge(held)
                    held = []
                now = k
                held.append(p.as_py())
        if held:
            yield from merge(held)

    return run


def _count_pairs(hundredths: int):
    """The function that counts, over rows (members, sizes, lists) in ascending order of size, the lists that two sets share, with how many they need."""

    def count(many, lists, sig, size):
        import pyarrow as pa

        of, weight = np.repeat(np.arange(len(many)), many), np.repeat(lists, many)
        found = []
        for d in range(1, int(many.max())):
            hit = np.flatnonzero((of[d:] == of[:-d]) & (100 * size[:-d] >= hundredths * size[d:]))
            if len(hit):
                x, y = sig[hit], sig[hit + d]
                n, m = size[hit], size[hit + d]  # n <= m
                need = overlap_needed(n, m, hundredths) - (-(-hundredths * m // 100) - 1)
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y), weight[hit], need], 1))
        pairs = np.concatenate(found)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(1)
        head = np.flatnonzero(new)
        cols = [pairs[head, 0], pairs[head, 1], np.add.reduceat(pairs[:, 2], head), pairs[head, 3]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], ["a", "b", "size", "need"])

    def run(batches):
        held, pairs = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            many = np.diff(b.column(0).offsets.to_numpy())
            held.append((many, b.column(2).to_numpy(), b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()))
            pairs += int((many.astype(np.int64) * (many - 1) // 2).sum())
            if pairs >= COUNTED:
                yield count(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, pairs = [], 0
        if held:
            yield count(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _sets(docs: DataFrame, ids: DataFrame, taken: frozenset, pack=np.ndarray.tobytes) -> DataFrame:
    """(sig, shingles) for the documents in ``ids`` (doc_id): the sorted hashes as bytes, or what ``pack`` makes of them."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = list(shingle_sets(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s, taken) for s in sets], pa.int64()), pa.array([pack(s) for s in sets], pa.binary())], ["sig", "shingles"])

    return docs.join(ids, "doc_id", "left_semi").select("text").mapInArrow(run, "sig long, shingles binary")


def _parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits in bytes; a bit is set if an odd number of the hashes fall on it."""
    return np.packbits((np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype("u1"), bitorder="little")


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITMAP_WORDS signed words of parities of the hashes."""
    return _parities(hashes, 64 * BITMAP_WORDS).view("<i8")


def outline(hashes: np.ndarray) -> bytes:
    """The number of the hashes and their parities in a power of two of bits, OUTLINE_BITS or more for each hash."""
    return np.uint64(len(hashes)).tobytes() + _parities(hashes, 1 << max(6, (OUTLINE_BITS * len(hashes) - 1).bit_length())).tobytes()


def _halved(bits: np.ndarray, to: int) -> np.ndarray:
    """Parities in the fewer bits of ``to`` bytes."""
    while len(bits) > to:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(query: bytes, candidates: list[bytes], hundredths: int = HUNDREDTHS) -> list[int]:
    """The places of the candidates whose outlines don't rule out that their sets are similar enough to the query's."""
    n, own, out = int(np.frombuffer(query, "<u8", 1)[0]), np.frombuffer(query, "u1", -1, 8), []
    for i, c in enumerate(candidates):
        m, other = int(np.frombuffer(c, "<u8", 1)[0]), np.frombuffer(c, "u1", -1, 8)
        to = min(len(own), len(other))
        # each shingle that only one set has turns one bit
        if int(np.bitwise_count(_halved(own, to) ^ _halved(other, to)).sum()) <= n + m - 2 * overlap_needed(n, m, hundredths):
            out.append(i)
    return out


def _similar(query: bytes, candidates: list[bytes], hundredths: int) -> list[int]:
    return divide_skip(np.frombuffer(query, "<u8"), [np.frombuffer(c, "<u8") for c in candidates], hundredths)


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(sig, bits) for a table of (sig, shingles)."""
    names = [f"w{k}" for k in range(BITMAP_WORDS)]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            words = np.array([bitmap(np.frombuffer(x.as_py(), "<u8")) for x in b.column(1)], "<i8").reshape(-1, BITMAP_WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(BITMAP_WORDS))], ["sig", *names])

    wide = sets.select("sig", "shingles").mapInArrow(run, "sig long, " + ", ".join(f"{n} long" for n in names))
    return wide.select("sig", F.struct(*names).alias("bits"))


def _search(pairs: DataFrame, sets: DataFrame, hundredths: int, test=_similar) -> DataFrame:
    """The pairs (a, b) of a written table whose sets pass the test. A query goes with up to about CHUNK candidates to a task."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunked = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    members = sets.join(small(chunked, pairs), F.col("b") == sets.sig).select("a", "chunk", "b", "shingles")
    # a chunk that no candidate fell to has its query only, and finds nothing
    heads = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    heads = sets.join(small(heads, pairs), F.col("a") == sets.sig).select("a", "chunk", F.lit(None).cast("long").alias("b"), "shingles")
    rows = members.unionByName(heads).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        key, query, names, sets_ = None, None, [], []

        def close():
            # only a text that has no id but null isn't there
            hits = [names[i] for i in test(query, sets_, hundredths)] if query is not None else []
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hits), pa.int64()), pa.array(hits, pa.int64())], ["src", "dst"])

        for batch in batches:
            for a, chunk, b, x in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (a, chunk) != key:
                    if names:
                        yield close()
                    key, query, names, sets_ = (a, chunk), None, [], []
                if b is None:
                    query = x.as_py()
                else:
                    names.append(b)
                    sets_.append(x.as_py())
        if names:
            yield close()

    return rows.mapInArrow(run, "src long, dst long")


def _long_lists(big: DataFrame, links: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """The links with those that the lists of over PAIRED members add, so that their classes are whole."""
    # sizes that can be similar enough, and as many long short lists in common as the pair needs; pairs that
    # share other short lists, too, have been searched before
    needed = _needed("p_size", "size", hundredths)
    differ = " + ".join(f"bit_count(p_bits.w{k} ^ bits.w{k})" for k in range(BITMAP_WORDS))
    compatible = F.expr(
        f"100 * least(p_size, size) >= {hundredths} * greatest(p_size, size) and least(p_lists, lists) >= {needed}"
        f" and {differ} <= p_size + size - 2 * ceil({hundredths} * (p_size + size) / {100 + hundredths})"
        f" and size(array_intersect(p_ids, ids)) >= {needed} and list = array_min(array_intersect(p_open, ids))"
    )

    def tested(pivots: DataFrame, members: DataFrame) -> DataFrame:
        """The pairs (a, b) of a pivot and a member of another class that may be similar enough."""
        # a set that has left a list was a pivot there and met the others of it then
        both = members.withColumn("list", F.explode("open")).join(pivots, "list").where((F.col("label") != F.col("p_label")) & compatible)
        return both.select(F.col("p_sig").alias("a"), F.col("sig").alias("b"))

    def opened(rows: DataFrame) -> DataFrame:
        return rows.groupBy("sig").agg(F.collect_list("list").alias("open"))

    # one row a set, with the long lists that it still is open in
    members, step, old = big.withColumn("open", F.col("ids")), 0, []
    while True:
        step += 1
        c = components(links)
        # a star for each class stands for all its links
        links = written(c.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst")), "links")
        members = members.join(c, members.sig == c.node, "left").select("sig", "size", "lists", "ids", "bits", "open", F.coalesce("component", "sig").alias("label"))
        members = written(members, "lists")
        for table in old:
            dropped(table)
        rows = members.select("sig", "label", F.explode("open").alias("list"))
        classes = rows.groupBy("list", "label").agg(F.count("*").alias("n"), F.min("sig").alias("sig"))
        lists = classes.groupBy("list").agg(F.count("*").alias("classes"), F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("top"), F.min("sig").alias("least"))
        lists = written(lists.where("classes > 1"), "open")
        if lists.isEmpty():
            return links
        open_ = rows.join(small(lists), "list")
        if step == 1:
            pivots = open_.where("sig = least")
        else:
            outside = F.col("m") - F.col("top.n")
            share = F.lit(float(DRAWN) * GROWTH ** min(step - 2, 20)) / outside
            draw = F.shiftrightunsigned(F.xxhash64("sig", F.lit(step)), 11) / F.lit(float(1 << 53))
            first = open_.where("label <> top.label").groupBy("list").agg(F.min("sig").alias("next"))
            pivots = open_.join(first, "list").where("label <> top.label").where((draw < share) | (F.col("sig") == F.col("next")))
        drawn = written(pivots.select("list", "sig"), "drawn")
        lists_of = drawn.groupBy("sig").agg(F.collect_list("list").alias("p_open"))
        pivots = members.join(small(lists_of, drawn), "sig").withColumn("list", F.explode("p_open"))
        pivots = written(pivots.select("list", F.col("sig").alias("p_sig"), F.col("size").alias("p_size"), F.col("lists").alias("p_lists"), F.col("ids").alias("p_ids"), F.col("bits").alias("p_bits"), F.col("label").alias("p_label"), "p_open"), "pivots")
        # lists that are of one class by now have no pivots, and their members need not be spread over them again
        still = rows.join(small(lists.select("list"), lists), "list", "left_semi")
        facts = members.drop("open")
        pairs = written(tested(small(pivots), facts.join(opened(still), "sig")), "tests")
        found = written(_search(pairs, sets, hundredths), "links")
        old = [lists, drawn, pivots, pairs, links, found, members]
        links = links.unionByName(found)
        members = facts.join(opened(still.join(small(drawn), ["list", "sig"], "left_anti")), "sig")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hundredths: int = HUNDREDTHS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id: the smallest id reachable by links.

    Two documents link when their sets of distinct five-word shingles have a Jaccard similarity of
    ``hundredths`` / 100 or more; equal sets always do. Documents without words link with nothing. Rows
    that repeat an id are one document each. Null ids are never the smallest; a text that only rows with a
    null id have links with no other text. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 500)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed, taken = _told_apart(docs)
    groups = signed.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    postings = _short_lists(docs, _sketch(docs), buckets, hundredths, taken).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    found = written(postings.mapInArrow(_merge_lists(hundredths), "list long, sig long, size long, members array<long>, sizes array<long>, lists long"), "found")
    big = found.where("list is not null").select("list", "sig", "size")
    in_big = written(big.groupBy("sig").agg(F.count("*").alias("lists"), F.collect_list("list").alias("ids"), F.min("size").alias("size")), "in_big")
    rows = found.where("list is null").repartition(buckets, "sig").sortWithinPartitions("sig").select("members", "sizes", "lists")
    counted = written(rows.mapInArrow(_count_pairs(hundredths), "a long, b long, size long, need long"), "counted")
    shared = counted.groupBy("a", "b").agg(F.sum("size").alias("size"), F.max("need").alias("need"))
    both = [small(in_big.select(F.col("sig").alias(x), F.col("ids").alias(f"{x}_ids")), in_big) for x in ("a", "b")]
    shared = shared.where("size >= need").union(shared.where("size < need").join(both[0], "a").join(both[1], "b").where("`size` + size(array_intersect(a_ids, b_ids)) >= need").select("a", "b", "size", "need"))
    pairs = written(shared.select("a", "b"), "pairs")

    def fetched(sigs: DataFrame, of: DataFrame, name: str, **how) -> DataFrame:
        ids = written(groups.join(small(sigs, of), "sig", "left_semi").where("rep is not null").select(F.col("rep").alias("doc_id")), "wanted")
        return written(_sets(docs, small(ids), taken, **how), name)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()

    outlines = fetched(ends(pairs), pairs, "outlines", pack=outline)
    likely = written(_search(pairs, outlines, hundredths, may_link).toDF("a", "b"), "likely")
    for table in (found, counted, pairs, outlines):
        dropped(table)
    wanted = written(ends(likely).union(in_big.select("sig")).distinct(), "wanted")
    sets = fetched(wanted, wanted, "sets")
    links = written(_search(likely, sets, hundredths), "links")
    if not in_big.isEmpty():
        bits = written(_bitmaps(sets), "bitmaps")
        links = _long_lists(in_big.join(small(bits), "sig"), links, sets, hundredths)
    joined = components(links).withColumnRenamed("node", "sig")
    for table in (likely, sets, links):
        dropped(table)
    known = written(groups.join(joined, "sig", "left").where("copies > 1 or component is not null").select("sig", "rep", F.coalesce("component", "sig").alias("component")), "classes")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    table = written(known.join(least, "component").select("sig", "component_id"), "classes")
    rows = signed.join(small(table), "sig", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hundredths: int = HUNDREDTHS) -> DataFrame:
    """The documents whose id is their class's smallest. Rows that repeat an id stay or go together; null ids stay."""
    classes = jaccard_classes(docs, id_col, text_col, hundredths)
    goes = written(classes.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct(), "goes")
    return docs.join(small(goes), id_col, "left_anti")
