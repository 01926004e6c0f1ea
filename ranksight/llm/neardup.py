"""Near-duplicate texts: a binary trie self-join over bit signatures, sharded so that no pair is lost.

* A text is the set of its word runs. Equal sets are one *class*; copies cost nothing further.
* Its signature has one bit per residue of the run hashes, the parity of the runs that fall there. Two signatures
  differ in at most as many bits as the sets differ in runs, and similarity t leaves at most
  (|a| + |b|)(1 - t)/(1 + t) differing runs: that is the Hamming error budget, and it loses no pair.
* A budget of a third of all runs prunes nothing near the root of one trie over all texts, so the trie is cut into
  shards by a lossless rule: sets of similarity t share one of their (1 - t)|a| + 1 rarest runs. Each such run is a shard.
* In every shard node pairs of the trie are walked together, differing bits are added up, and a pair of nodes is
  dropped when they exceed the budget. Survivors are compared exactly.
* Runs in very many texts are shards too: they are cut into blocks, and each pair of blocks is a shard of bounded size.
* Families, texts that follow one template, would make a pair of any two of them. They are joined first: texts with the
  same smallest hash among their frequent runs are put in a random order, and neighbours in it are compared. What that
  joins is one component, and from then on pairs inside a component, or inside one group of texts that can't be linked
  to each other, are left out: of shards, of block pairs and of pairs of trie nodes. A link between components is never
  left out, so the components at the end are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksight.llm.shingles import bounded, mix, run_hashes, word_hashes
from ranksight.operators.components import connected_components
from ranksight.runtime import broadcast_if_small, materialize, parallelism, spread

BITS = 256
#: Runs are told apart by 48 bits of their hash: two of the runs of a pair of texts coincide by chance once in 10^10 pairs of 200 runs.
RUN_BYTES = 6
#: Bytes of text or runs that are worked on at a time, so that long texts don't add up in a worker.
BATCH_BYTES = 16_000_000
RUN_MASK = np.uint64((1 << 8 * RUN_BYTES) - 1)
SIGNATURE = [f"s{i}" for i in range(BITS // 64)]


@dataclass(frozen=True)
class NearDupConfig:
    """``min_words`` leaves shorter texts out; without it every text that has a run takes part. ``sketch`` bounds the bytes of the sketch of run counts, ``shard_cap`` the members of a shard's block, ``part_cap`` those of a run that
    one task looks through. In shards of up to ``paired`` members those that can have no partner there, by sizes and places of the shared run, are dropped early.
    Runs in more than ``family`` texts are looked at for families. None of these changes the result."""

    words: int = 5
    similarity: float = 0.8
    min_words: int = 0
    sketch: int = 1 << 24
    shard_cap: int = 2_048
    paired: int = 64
    part_cap: int = 1 << 17
    family: int = 256
    pack_rows: int = 400_000

    def budget(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most runs in which sets of these sizes may differ and still be similar."""
        return np.floor((a + b) * (1 - self.similarity) / (1 + self.similarity) + 1e-9)

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least runs that similar sets of these sizes share."""
        return np.ceil((a + b) * self.similarity / (1 + self.similarity) - 1e-9)

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """Rarest runs of which similar sets share at least one."""
        return size - np.ceil(size * self.similarity - 1e-9).astype(np.int64) + 1


def signatures(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """[n, BITS / 64] uint64: bit b is the parity of the owner's tokens with residue b."""
    ones = np.bincount(owner * BITS + (tokens % np.uint64(BITS)).astype(np.int64), minlength=n * BITS) & 1
    return np.packbits(ones.astype(np.uint8).reshape(n, BITS), axis=1).view(">u8").astype(np.uint64).reshape(n, BITS // 64)


def trie_self_join(shard: np.ndarray, sig: np.ndarray, size: np.ndarray, cfg: NearDupConfig, *labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one shard whose signatures differ in at most their Hamming budget.

    The trie is the rows sorted by (shard, signature): a node is a range of rows that agree on the bits above its
    depth. All node pairs of one depth are expanded together; pairs of single rows are settled at once. Rows with the
    same value of one of the ``labels`` need no pair; a pair of nodes that hold one value only is not expanded.
    """
    order = np.lexsort((*sig.T[::-1], shard))
    shard, sig, size = shard[order], sig[order], size[order].astype(np.int64)
    labels = [x[order] for x in labels]
    ends = []  # where the run of equal labels ends that each row lies in
    for x in labels:
        last = np.r_[np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)]
        ends.append(last[np.searchsorted(last, np.arange(len(x)), side="right")] if len(x) else last)

    def needed(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        ok = np.ones(len(alo), bool)
        for x, end in zip(labels, ends):
            ok &= (end[alo] < ahi) | (end[blo] < bhi) | (x[alo] != x[blo])
        return ok

    start = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    end = np.r_[start[1:], len(shard)]
    largest = np.maximum.reduceat(size, start) if len(start) else start
    keep = (end - start > 1) & needed(start, end, start, end) if len(start) else end > start
    alo, ahi = start[keep], end[keep]
    blo, bhi, acc, top = alo.copy(), ahi.copy(), np.zeros(len(alo), np.int64), largest[keep]
    left, right = [], []
    for depth in range(BITS + 1):
        single = (ahi - alo == 1) & (bhi - blo == 1)
        done = single & (alo != blo)
        left.append(alo[done])
        right.append(blo[done])
        alive = ~single
        alo, ahi, blo, bhi, acc, top = (x[alive] for x in (alo, ahi, blo, bhi, acc, top))
        if not len(alo):
            break
        if depth == BITS:  # equal signatures: all pairs of the two ranges
            for a0, a1, b0, b1 in zip(alo, ahi, blo, bhi):
                x, y = np.meshgrid(np.arange(a0, a1), np.arange(b0, b1), indexing="ij")
                pick = x < y if a0 == b0 else np.ones_like(x, bool)
                left.append(x[pick])
                right.append(y[pick])
            break
        bit = (sig[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
        ones = np.r_[0, np.cumsum(bit.astype(np.int64))]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        zero = (alo, amid, blo, bmid, acc, top)
        one = (amid, ahi, bmid, bhi, acc, top)
        cross = (alo, amid, bmid, bhi, acc + 1, top)
        back = tuple(x[~same] for x in (amid, ahi, blo, bmid, acc + 1, top))
        alo, ahi, blo, bhi, acc, top = (np.concatenate(x) for x in zip(zero, one, cross, back))
        ok = np.flatnonzero((ahi > alo) & (bhi > blo) & (acc <= cfg.budget(top, top)))
        ok = ok[needed(alo[ok], ahi[ok], blo[ok], bhi[ok])]
        alo, ahi, blo, bhi, acc, top = (x[ok] for x in (alo, ahi, blo, bhi, acc, top))
    a, b = np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)
    differ = np.bitwise_count(sig[a] ^ sig[b]).sum(axis=1)
    ok = differ <= cfg.budget(size[a], size[b])
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    ok &= small >= large * cfg.similarity - 1e-9
    for x in labels:
        ok &= x[a] != x[b]
    return order[a[ok]], order[b[ok]]


def text_sets(texts: DataFrame, cfg: NearDupConfig, id_col: str, text_col: str, group_col: str | None) -> DataFrame:
    """(id, grp, cls, size, s0.., runs) of each text with enough words; ``runs`` are the sorted distinct run hashes.

    ``grp`` is the group name without outer blanks in lower case; with a group column, rows without a name are left out.
    """
    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")] + ([F.col(group_col).alias("grp")] if group_col else [F.lit("").alias("grp")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in bounded(b, 1, BATCH_BYTES)):
            ids, grp = b.column(0), [g.strip().lower() if g is not None else None for g in b.column(2).to_pylist()]
            words, sizes = word_hashes(b.column(1).to_pylist())
            h, owner, _ = run_hashes(words, sizes, cfg.words)
            h &= RUN_MASK
            o = np.lexsort((h, owner))
            h, owner = h[o], owner[o]
            if len(h):
                first = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
                h, owner = h[first], owner[first]
            n = len(sizes)
            size = np.bincount(owner, minlength=n)
            ok = (sizes >= cfg.min_words) & (size > 0) & np.array([g is not None for g in grp], bool) & ~np.asarray(ids.is_null())
            total = np.zeros(n, np.uint64)
            filled = np.flatnonzero(size)
            if len(filled):
                total[filled] = np.add.reduceat(mix(h ^ np.uint64(0x51ED270B27BC6A1D)), np.r_[0, np.cumsum(size)][filled])
            cls = mix(total + size.astype(np.uint64))
            sig = signatures(h, owner, n)
            cut = np.r_[0, np.cumsum(size)]
            rows = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids.fill_null(0).to_numpy(zero_copy_only=False)[rows]), pa.array([grp[i] for i in rows], pa.string()), pa.array(cls[rows].view(np.int64)), pa.array(size[rows].astype(np.int32)),
                    *[pa.array(np.ascontiguousarray(sig[rows, i]).view(np.int64)) for i in range(len(SIGNATURE))], pa.array([_packed(h[cut[i] : cut[i + 1]]) for i in rows], pa.binary()),
                ],
                names=["id", "grp", "cls", "size", *SIGNATURE, "runs"],
            )

    return spread(texts.select(*columns)).mapInArrow(build, f"id long, grp string, cls long, size int, {' long, '.join(SIGNATURE)} long, runs binary")


def _packed(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :RUN_BYTES]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // RUN_BYTES, 8), np.uint8)
    wide[:, :RUN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, RUN_BYTES)
    return wide.view(np.uint64).ravel()


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    runs = batch.column(batch.schema.get_field_index("runs"))
    return _unpacked(b"".join(runs.to_pylist())), batch.column(batch.schema.get_field_index("size")).to_numpy().astype(np.int64)


def spark_cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def run_sketch(sets: DataFrame, total: int, cfg: NearDupConfig) -> np.ndarray:
    """A count sketch of the runs of all texts: uint8 codes that grow with the number of texts in a bucket.

    It ranks runs from rare to frequent. Any ranking gives the same links; a close one keeps the shards small. Its size
    follows the collection up to ``sketch`` buckets, so the driver holds and broadcasts at most that many bytes. As many
    tasks count as there are cores, each over several splits, so what is shuffled follows the cluster, not the collection.
    """
    size = 1 << 16
    while size < min(cfg.sketch, total // 4):
        size *= 2
    segments = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.uint32)
        for b in batches:
            h, _ = _flat(b)
            np.add.at(seen, (h & np.uint64(size - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(segments)), pa.array([_planes(x) for x in seen.reshape(segments, -1)], pa.binary())], names=["segment", "counts"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, total = None, None
        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != segment and total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([_code(total).tobytes()], pa.binary())], names=["segment", "codes"])
                    total = None
                segment = s
                part = _unplanes(raw, np.uint32).astype(np.int64)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([_code(total).tobytes()], pa.binary())], names=["segment", "codes"])

    cores = spark_cores(sets)
    parts = sets.select("size", "runs").coalesce(cores).mapInArrow(count, "segment long, counts binary")
    found = parts.repartition(min(segments, cores), "segment").sortWithinPartitions("segment").mapInArrow(code, "segment long, codes binary").toArrow()
    out = np.zeros((segments, size // segments), np.uint8)
    for s, raw in zip(found.column("segment").to_pylist(), found.column("codes").to_pylist()):
        out[s] = np.frombuffer(raw, np.uint8)
    return out.ravel()


def _code(count: np.ndarray) -> np.ndarray:
    """Eight steps for each doubling of 1 + count."""
    return np.minimum(255, np.round(8 * np.log2(1.0 + count))).astype(np.uint8)


def _decode(code: np.ndarray) -> np.ndarray:
    return np.exp2(code / 8.0) - 1


def _planes(x: np.ndarray) -> bytes:
    """Bytes of one significance together, so that the zero bytes of small numbers vanish in the shuffle's compression."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy()


def _once(batch: pa.RecordBatch, *names: str) -> pa.RecordBatch:
    """The first row of each value; copies within a batch count once."""
    o = np.lexsort([_column(batch, n) for n in names])
    same = np.ones(max(len(o) - 1, 0), bool)
    for n in names:
        x = _column(batch, n)[o]
        same &= x[1:] == x[:-1]
    return batch.take(pa.array(np.sort(o[np.r_[True, ~same][: len(o)]])))


def family_candidates(sets: DataFrame, codes, cfg: NearDupConfig) -> DataFrame:
    """(a, b): class pairs of texts next to each other in a random order of those with the same smallest frequent run.

    Two independent hash functions give two orders, so the texts of a family hang together though no text has more than four
    partners. A bucket of any size is streamed in slices; the signatures sort out most neighbours that can't be similar.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in bounded(b, b.schema.get_field_index("runs"), BATCH_BYTES)):
            b = _once(b, "cls", "lab")
            h, size = _flat(b)
            count = _decode(codes.value[(h & np.uint64(len(codes.value) - 1)).astype(np.int64)])
            owner = np.repeat(np.arange(len(size)), size)[count > cfg.family]
            h = h[count > cfg.family]
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
            if not len(start):
                continue
            rows = b.take(pa.array(owner[start]))
            for j in range(2):
                bucket = np.minimum.reduceat(mix(h ^ np.uint64(0xA0761D6478BD642F + j)), start)
                draw = mix(_column(rows, "cls").view(np.uint64) + np.uint64(0xE7037ED1A0B428DB + j))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array((draw >> np.uint64(60)).astype(np.int32)), pa.array(draw.view(np.int64)), *[rows.column(rows.schema.get_field_index(n)) for n in ("cls", "lab", "size", *SIGNATURE)]], names=["bucket", "slice", "draw", "cls", "lab", "size", *SIGNATURE])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, cls, lab, size = (_column(b, n) for n in ("bucket", "cls", "lab", "size"))
            sig = np.stack([_column(b, n) for n in SIGNATURE], axis=1).view(np.uint64)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            long = np.repeat(np.diff(cut) >= cfg.family // 16, np.diff(cut))  # smaller ones are no matter
            for k in (1, 2):
                i = np.flatnonzero((bucket[k:] == bucket[:-k]) & long[k:] & (cls[k:] != cls[:-k]) & (lab[k:] != lab[:-k]))
                ok = np.bitwise_count(sig[i] ^ sig[i + k]).sum(axis=1) <= cfg.budget(size[i], size[i + k])
                x, y = cls[i[ok]], cls[i[ok] + k]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    rows = f"cls long, lab long, size int, {' long, '.join(SIGNATURE)} long"
    found = sets.select("cls", "lab", "size", *SIGNATURE, "runs").mapInArrow(emit, f"bucket long, slice int, draw long, {rows}")
    return found.repartition("bucket", "slice").sortWithinPartitions("bucket", "draw").mapInArrow(chain, "a long, b long").distinct()


def shard_members(sets: DataFrame, codes, rows: int, cfg: NearDupConfig) -> DataFrame:
    """(shard, id): the shards, each with at least two ids, in which each text takes part; ``rows`` counts the runs of all."""
    spark = sets.sparkSession
    parts = max(1, max(parallelism(spark), int(rows * (1 - cfg.similarity)) // cfg.pack_rows))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in bounded(b, b.schema.get_field_index("runs"), BATCH_BYTES)):
            b = _once(b, "cls", "lab")
            ids, comp, lab = (_column(b, n) for n in ("id", "comp", "lab"))
            h, size = _flat(b)
            owner = np.repeat(np.arange(len(size)), size)
            n = codes.value[(h & np.uint64(len(codes.value) - 1)).astype(np.int64)]
            o = np.lexsort((h, n, owner))
            place = np.arange(len(h)) - np.r_[0, np.cumsum(size)][:-1][owner]
            pick = place < cfg.prefix(size)[owner]
            h, n, row, place = h[o[pick]], n[o[pick]], owner[pick], place[pick]
            # a run of more texts than a task looks through is cut into blocks; a member joins all pairs with its block
            blocks = np.maximum(1, np.ceil(_decode(n) / cfg.part_cap)).astype(np.int64)
            mine = (mix(ids[row].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            rep = np.repeat(np.arange(len(h)), blocks)
            other = np.arange(len(rep)) - np.repeat(np.r_[0, np.cumsum(blocks)][:-1], blocks)
            lo, hi = np.minimum(mine[rep], other), np.maximum(mine[rep], other)
            shard = np.where(blocks[rep] > 1, mix(h[rep] + (lo * 65_537 + hi + 1).astype(np.uint64)) & RUN_MASK, h[rep])
            hot = _decode(n[rep]) > cfg.paired
            row, place = row[rep], place[rep].astype(np.int32)
            part = (mix(shard) % np.uint64(parts)).astype(np.int64) * 2 + hot  # rows of frequent runs come with their labels
            o = np.lexsort((shard, part))
            shard, row, place, part = shard[o], row[o], place[o], part[o]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
            cols = [pa.array([pack(x[i:j]) for i, j in spans], pa.binary()) for x, pack in ((shard, _packed), (ids[row], _planes), (size[row].astype(np.int32), _planes), (place, _planes))]
            cols += [pa.array([_planes(x[row[i:j]]) if part[i] & 1 else None for i, j in spans], pa.binary()) for x in (comp, lab)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), *cols], names=["part", "shard", "member", "size", "place", "comp", "lab"])

    def rare(held: list) -> tuple[np.ndarray, np.ndarray]:
        """Of shards of few texts, the members that may have a partner there."""
        shard = np.concatenate([_unpacked(x[0]) for x in held])
        member, size, place = (np.concatenate([_unplanes(x[i], k) for x in held]) for i, k in ((1, np.int64), (2, np.int32), (3, np.int32)))
        o = np.argsort(shard, kind="stable")
        shard, member, size, place = shard[o], member[o], size[o].astype(np.int64), place[o].astype(np.int64)
        start = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        count = np.diff(np.r_[start, len(shard)])
        group = np.repeat(np.arange(len(start)), count)
        ok = count[group] > cfg.paired
        small = np.where(ok, -1 - np.arange(len(shard)), group)
        for k in range(1, min(cfg.paired, int(count.max()))):
            a = np.flatnonzero(small[k:] == small[:-k])
            b = a + k
            # the first run two similar sets share leaves enough runs behind it in both
            most = 1 + np.minimum(size[a] - place[a], size[b] - place[b]) - 1
            good = (most >= cfg.overlap(size[a], size[b])) & (member[a] != member[b])
            ok[a[good]] = True
            ok[b[good]] = True
        return shard[ok], member[ok]

    def frequent(held: list) -> tuple[np.ndarray, np.ndarray]:
        """Members of shards of many texts, in blocks of bounded size, without what one label holds together."""
        shard = np.concatenate([_unpacked(x[0]) for x in held])
        member, comp, lab = (np.concatenate([_unplanes(x[i], np.int64) for x in held]) for i in (1, 4, 5))
        o = np.argsort(shard, kind="stable")
        shard, member, comp, lab = shard[o], member[o], comp[o], lab[o]
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        out: list[tuple[np.ndarray, np.ndarray]] = [(shard[:0], member[:0])]
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            out += blocks_of(shard[i], member[i:j], (comp[i:j], lab[i:j]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def blocks_of(h: np.uint64, member: np.ndarray, labels: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if any((x == x[0]).all() for x in labels):
            return
        if len(member) <= cfg.shard_cap:
            yield np.full(len(member), h), member
            return
        # the most frequent label of the shard needs no pairs among its own: its blocks meet those of the others only
        best = np.zeros(len(member), bool)
        for x in labels:
            value, of, n = np.unique(x, return_inverse=True, return_counts=True)
            if n.max() > max(1, best.sum()):
                best = of == n.argmax()
        own, rest = member[best], member[~best]
        cut = lambda x: [x[k :: max(1, -(-len(x) // cfg.shard_cap))] for k in range(max(1, -(-len(x) // cfg.shard_cap)))] if len(x) else []
        own, rest = cut(own), cut(rest)
        code = 1
        for k, x in enumerate(rest):
            for y in [*own, *rest[k:]]:
                both = x if y is x else np.concatenate([x, y])
                if y is not x or len(rest) == 1 and not own:
                    yield np.full(len(both), mix(np.array([h + np.uint64(code << 40)]))[0] & RUN_MASK), both
                code += 1

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part comes in one piece of rows and is held as a whole: some ``pack_rows`` members, or two blocks of ``part_cap``."""
        part, held = None, []

        def flush() -> pa.RecordBatch:
            shard, member = frequent(held) if part & 1 else rare(held)
            return pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), pa.array(member)], names=["shard", "id"])

        for b in batches:
            for p, *packed in zip(*(b.column(i).to_pylist() for i in range(7))):
                if p != part and held:
                    yield flush()
                    held = []
                part = p
                held.append(packed)
        if held:
            yield flush()

    packed = sets.select("id", "cls", "lab", "comp", "size", "runs").mapInArrow(emit, "part long, shard binary, member binary, size binary, place binary, comp binary, lab binary")
    return packed.repartition(min(2 * parts, 4 * parallelism(spark)), "part").sortWithinPartitions("part").mapInArrow(survivors, "shard long, id long")


def candidate_pairs(members: DataFrame, sets: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(a, b): pairs of classes, a < b, that the trie self-join leaves in some shard."""
    spark = sets.sparkSession
    signed = members.join(sets.select("id", "cls", "comp", "lab", "size", *SIGNATURE).dropDuplicates(["id", "cls"]), "id").select("shard", "cls", "comp", "lab", "size", *SIGNATURE)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def pairs(x: list[np.ndarray]) -> pa.RecordBatch:
            shard, cls, comp, lab, size, *sig = x
            a, b = trie_self_join(shard, np.stack(sig, axis=1).view(np.uint64), size, cfg, comp, lab)
            a, b = cls[a], cls[b]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:  # sorted by shard; the last shard of a batch may go on in the next
            now = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            rest = [x[cut:] for x in now]
            if cut:
                yield pairs([x[:cut] for x in now])
        if rest is not None:
            yield pairs(rest)

    return signed.repartition("shard").sortWithinPartitions("shard").mapInArrow(join, "a long, b long").distinct()


def _fixed_filter(ids: DataFrame, words: int = 1 << 17) -> np.ndarray:
    """A Bloom filter of fixed size (words * 64 bits) over a column of longs; the driver holds only the filter."""
    bits = words * 64
    spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(bits)) for i in range(3)])).alias("at"))
    found = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def verified_links(candidates: DataFrame, sets: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(a, b, similarity) of the candidate classes whose exact similarity reaches the threshold."""
    spark = sets.sparkSession
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id"))
    bloom = spark.sparkContext.broadcast(_fixed_filter(wanted))
    bits = len(bloom.value) * 64
    spots = sets.select("cls", "runs", *[F.pmod(F.xxhash64("cls", F.lit(i)), F.lit(bits)).alias(f"at{i}") for i in range(3)])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for i in range(2, 5):
                at = b.column(i).to_numpy()
                ok &= (bloom.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            rows = np.flatnonzero(ok)
            if len(rows):
                rows = rows[np.unique(b.column(0).to_numpy()[rows], return_index=True)[1]]
            yield b.select(["cls", "runs"]).take(pa.array(rows))

    kept = spots.mapInArrow(needed, "cls long, runs binary").groupBy("cls").agg(F.first("runs").alias("runs"))
    joined = candidates.join(kept.select(F.col("cls").alias("a"), F.col("runs").alias("ra")), "a").join(kept.select(F.col("cls").alias("b"), F.col("runs").alias("rb")), "b").select("a", "b", "ra", "rb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ra, rb = b.column(2).to_pylist(), b.column(3).to_pylist()
            x, y = _unpacked(b"".join(ra)), _unpacked(b"".join(rb))
            na, nb = np.array([len(r) // RUN_BYTES for r in ra], np.int64), np.array([len(r) // RUN_BYTES for r in rb], np.int64)
            pair = np.r_[np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)]
            h = np.r_[x, y]
            o = np.lexsort((h, pair))
            h, pair = h[o], pair[o]
            both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=len(na)) if len(h) else np.zeros(len(na), np.int64)
            sim = both / np.maximum(na + nb - both, 1)
            ok = sim >= cfg.similarity
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)), pa.array(sim[ok])], names=["a", "b", "similarity"])

    return joined.mapInArrow(compare, "a long, b long, similarity double")


def near_duplicate_groups(texts: DataFrame, cfg: NearDupConfig = NearDupConfig(), id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """One row per grouped text: (id, group_id, class_id), named by the smallest ids of the group and of the class.

    Groups are joined by links, directly or through others.

    Two texts are linked if their word-run sets have at least ``similarity`` (intersection over union) and, with
    ``group_col``, their group names differ (without outer blanks, in lower case). Null ids, null texts, texts of fewer
    than ``words`` or ``min_words`` words and, with ``group_col``, null group names take no part. Rows delivered twice count once;
    texts with equal run sets have one ``class_id``. Texts without a link don't come out; an empty table gives no rows.
    """
    spark = texts.sparkSession
    sets = materialize(text_sets(texts, cfg, id_col, text_col, group_col), "text_sets")
    classes = materialize(sets.groupBy("cls").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.countDistinct("id").alias("n")), "classes")
    # texts with the same label can't be linked: those of one group, or else a text and itself
    sets = sets.withColumn("lab", F.xxhash64("grp") if group_col else F.col("cls"))
    runs = sets.agg(F.sum("size")).first()[0] or 0
    codes = spark.sparkContext.broadcast(run_sketch(sets, runs, cfg))  # at most cfg.sketch bytes

    def links(candidates: DataFrame) -> DataFrame:
        found = verified_links(candidates, sets, cfg).select("a", "b")
        if not group_col:
            return found
        one = classes.select(F.col("cls").alias("a"), F.col("g0").alias("a0"), F.col("g1").alias("a1"))
        two = classes.select(F.col("cls").alias("b"), F.col("g0").alias("b0"), F.col("g1").alias("b1"))
        return found.join(one, "a").join(two, "b").where(F.least("a0", "b0") != F.greatest("a1", "b1")).select("a", "b")

    first = materialize(family_candidates(sets, codes, cfg), "family_pairs")
    if first.isEmpty():
        edges, labelled = None, sets.withColumn("comp", F.col("cls"))
    else:
        edges = materialize(links(first), "family_links")
        family = connected_components(edges).select(F.col("node").alias("cls"), F.col("component").alias("comp"))
        labelled = sets.join(broadcast_if_small(family), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    candidates = materialize(candidate_pairs(shard_members(labelled, codes, runs, cfg), labelled, cfg), "pairs")
    found = links(candidates)
    parts = connected_components(found if edges is None else found.unionByName(edges))
    alone = classes.where("g0 != g1" if group_col else "n > 1")
    label = alone.select("cls").join(parts.withColumnRenamed("node", "cls"), "cls", "full").select("cls", F.coalesce("component", "cls").alias("group_id"))
    grouped = materialize(sets.select("id", "cls").distinct().join(label, "cls").select("id", "cls", "group_id").distinct(), "grouped")
    least = grouped.groupBy("cls", "group_id").agg(F.min("id").alias("class_id"))
    first = least.groupBy("group_id").agg(F.min("class_id").alias("first"))
    names = least.join(first, "group_id").select("cls", "class_id", "first")
    return grouped.join(names, "cls").select("id", F.col("first").alias("group_id"), "class_id")


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs within each group, smaller id first: the listed cases of a group, whatever its size."""
    a, b = groups.select("group_id", F.col("id").alias("chunk_id_a")), groups.select("group_id", F.col("id").alias("chunk_id_b"))
    return a.join(b, "group_id").where("chunk_id_a < chunk_id_b").select("chunk_id_a", "chunk_id_b").distinct()
