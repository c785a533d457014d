"""Best-fit packing of token pieces into sequences of a fixed length, in bulk-synchronous supersteps.

Documents are range-sorted by length across the cluster, so those of one length are a run of consecutive ranks, and
open sequences with one amount of room are runs of sequence numbers: a sweep moves runs, however many documents
they stand for. In a superstep the runs of documents and gaps are dealt, in order of size, to stripes that each
hold an even cross-section. Every stripe is swept by itself on the cluster: each run finds its successor, the least room that
holds it; runs that meet at one gap take it in order of rank, longest first; the gaps shrink and are offered again. What
found no gap is dealt anew to fewer stripes with all gaps that are left, and the last superstep opens sequences for the rest.
The documents then look up their places by length and rank.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators.shared import arrow_rows, fresh, ranked, small, written

#: Documents for each stripe of the first superstep, about, and the most stripes there are.
STRIPE_ROWS, MOST_STRIPES = 1 << 16, 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document; only documents longer than ``max_len`` have several.

    A null or empty text is ``end_id`` alone. The first piece of a long document is the short one. Null
    and repeated ids are kept as they are; other columns aren't read.
    """
    arrow_rows(docs.sparkSession, 2000)

    def run(batches):
        import zlib

        import pyarrow as pa

        from samewise.llm.tokens import encoder

        enc = encoder(tokenizer_path)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            every, many = enc.batch(b.column(1), end_id)
            data, begin = every.astype("<u4").tobytes(), 0
            for name, n in zip(b.column(0).to_pylist(), many.tolist(), strict=True):
                cuts = [0, *range(n % max_len or max_len, n + 1, max_len)]
                own, begin = begin, begin + n
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(out, (name, k, i, j - i, zlib.crc32(data[4 * (own + i) : 4 * (own + j)])), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, PIECES)


def best_fit(docs: list[tuple], gaps: list[tuple], max_len: int, base: int, last: bool) -> tuple[list, list, list]:
    """One sweep over runs of documents (length, first, n) and of gaps (room, sequence, n): (placed, left, gaps).

    Runs are taken longest first, those of one length by rank. Each takes the least room that holds it, run by run, and
    what is left of that room is a gap again. Documents of over half of ``max_len`` open sequences, numbered from
    ``base``, as nothing of their own kind fits beside them; others without a gap are left, or, in the ``last`` sweep,
    open as few sequences as hold them. placed: (length, first, n, sequence, offset).
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    for room, sequence, n in gaps:
        rooms.setdefault(room, []).append((sequence, n))
    order = sorted(rooms)
    placed, left = [], []

    def put(length: int, first: int, n: int, sequence: int, room: int) -> None:
        placed.append((length, first, n, sequence, max_len - room))
        if rest := room - length:
            if rest not in rooms:
                rooms[rest] = []
                bisect.insort(order, rest)
            rooms[rest].append((sequence, n))

    for length, first, n in sorted(docs, key=lambda d: (-d[0], d[1])):
        while n:
            i = bisect.bisect_left(order, length)
            if i < len(order):
                room = order[i]
                sequence, m = rooms[room].pop()
                take = min(n, m)
                if take < m:
                    rooms[room].append((sequence + take, m - take))
                elif not rooms[room]:
                    del rooms[order.pop(i)]
                put(length, first, take, sequence, room)
            elif last or 2 * length > max_len:
                take = -(-n // (max_len // length))
                put(length, first, take, base, max_len)
                base += take
            else:
                left.append((length, first, n))
                break
            first, n = first + take, n - take
    return placed, left, [(room, sequence, n) for room, runs in rooms.items() for sequence, n in runs]


def _dealt(runs: DataFrame, stripes: int) -> DataFrame:
    """Each run (kind, size, at, n, into) in ``stripes`` parts of about its length over their number."""
    cut = runs.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("skip", F.expr(f"n * stripe div {stripes}"))
    many = F.expr(f"n * (stripe + 1) div {stripes}") - F.col("skip")
    return cut.select("stripe", "kind", "size", (F.col("at") + F.col("skip")).alias("at"), many.alias("n")).where("n > 0")


def placements(runs: DataFrame, total: int, max_len: int, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """(size, at, n, sequence, place): where the documents of runs (size, at, n) go; size is their length, at the first one's rank.

    Supersteps: documents and gaps, in order of size, are dealt to stripes that each see every size; the stripes sweep by
    themselves, and what they leave, documents and gaps, is dealt to fewer stripes, until the last one opens sequences for
    all that still has none.
    """
    schema = "kind string, size long, at long, n long, sequence long, place long"
    stripes, step, now, found = int(min(MOST_STRIPES, max(1, total // stripe_rows))), 0, runs.select(F.lit("doc").alias("kind"), "size", "at", "n"), None
    while True:
        own, last = step, stripes == 1

        def sweep(pdf):
            import pandas as pd

            rows = {k: list(zip(*(pdf[pdf.kind == k][c].tolist() for c in ("size", "at", "n")), strict=True)) for k in ("doc", "gap")}
            placed, left, gaps = best_fit(rows["doc"], rows["gap"], max_len, (own << 52) + (int(pdf.stripe.iloc[0]) << 42), last)
            out = [("placed", *r) for r in placed] + [("doc", *r, 0, 0) for r in left] + [("gap", *r[:1], r[1], r[2], 0, 0) for r in gaps]
            return pd.DataFrame(out, columns=["kind", "size", "at", "n", "sequence", "place"])

        out = written(_dealt(now, stripes).groupBy("stripe").applyInPandas(sweep, schema), "sweep")
        got = out.where("kind = 'placed'").drop("kind")
        found = got if found is None else found.unionByName(got)
        if last:
            return found
        now, step, stripes = out.where("kind <> 'placed'").select("kind", "size", "at", "n"), step + 1, max(1, stripes // 8)


def pack(parts: DataFrame, max_len: int = 1024, length_col: str = "length", stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """Adds sequence_id and offset, in place of columns of these names, to rows with a length of 1 to ``max_len``.

    Other lengths are an error; an empty table stays empty. Equal lengths are told apart by the other columns' order, so reruns
    give the same sequences. Rows that are equal in all columns have places of their own.
    """
    parts = parts.drop("sequence_id", "offset")
    keys = [length_col, *[c for c in parts.columns if c != length_col]]
    rank = fresh(parts, "rank")
    rows = ranked(parts, keys, rank)
    runs = written(rows.groupBy(F.col(length_col).cast("long").alias("size")).agg(F.min(rank).alias("at"), F.count("*").alias("n")), "runs")  # max_len rows at most
    seen = runs.agg(F.min("size").alias("low"), F.max("size").alias("high"), F.sum("n").alias("n"), F.count("*").alias("lengths")).first()
    if seen.lengths and (seen.low is None or seen.low < 1 or seen.high > max_len):
        raise ValueError(f"lengths must be from 1 to {max_len}")
    size, at, n, sequence, place = (fresh(parts, x) for x in ("size", "at", "n", "sequence", "place"))
    table = written(placements(runs, seen.n or 0, max_len, stripe_rows).toDF(size, at, n, sequence, place), "placements")
    joined = rows.join(small(table), (F.col(length_col) == F.col(size)) & (F.col(rank) >= F.col(at)) & (F.col(rank) < F.col(at) + F.col(n)))
    return joined.select(*[f"`{c}`" for c in parts.columns], (F.col(sequence) + F.col(rank) - F.col(at)).alias("sequence_id"), F.col(place).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place in it; see ``pieces`` and ``pack``."""
    return pack(written(pieces(docs, tokenizer_path, end_id, max_len, id_col, text_col), "pieces"), max_len)
