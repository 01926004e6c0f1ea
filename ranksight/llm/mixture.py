"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. A source's weight follows a schedule of its own, linear between knots, whose mean is its share;
sources without one take what the others leave, in proportion to their shares. The integral of the schedule times the total
is the source's cumulative token demand D(t). Documents of a source follow each other in a fixed random order, epoch after
epoch; the token at which a use of a document begins, c, is drawn at the time t with D(t) = c: the piece of the schedule
that holds c is found, and its quadratic inverted. Sorting all uses by t over ranges gives the training order.

No source is gathered in one task: token offsets are prefix sums over (source, slice of the random order).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranksight.llm.terms import outer_trim
from ranksight.runtime import broadcast_if_small, materialize, parallelism, spread


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE vocabulary file (``token<space>rank`` lines, base64) and its splitting pattern."""

    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class MixtureConfig:
    """``total``: tokens of the mixture; None takes the most for which every source with documents keeps its share.

    ``schedules``: (time, relative weight) knots of a source's weight, from time 0 to 1; they are scaled to its share.
    ``slices``: least parts into which a source's random order is cut for its prefix sums; large sources get more, of
    about ``slice_rows`` documents.
    """

    total: int | None = None
    schedules: dict[str, tuple[tuple[float, float], ...]] = field(default_factory=dict)
    slices: int = 256
    slice_rows: int = 100_000
    seed: int = 17


_ENCODERS: dict[Tokenizer, object] = {}


def encoder(tok: Tokenizer):
    """The tokenizer, loaded once per process."""
    if tok not in _ENCODERS:
        import tiktoken

        with open(tok.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[tok] = tiktoken.Encoding(os.path.basename(tok.path), pat_str=tok.pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[tok]


def source_key(c: Column) -> Column:
    """Without outer blanks, in lower case, ``-`` as ``_``."""
    return F.translate(F.lower(outer_trim(c)), "-", "_")


def token_sizes(docs: DataFrame, tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, tokens); a null or empty text has 0 tokens, a null source stays null."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tok)
        for b in batches:
            n = np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=["doc_id", "source", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    return spread(rows).mapInArrow(size, "doc_id long, source string, tokens long")


def plan_shares(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[float, dict[str, float]]:
    """(total, tokens to use of each source): shares as near to the targets as the caps ``max_repeats`` allow.

    Sources without documents or without a share give nothing; the others keep their proportions. Without a total it is
    the most for which no cap binds. With one, capped sources give all they may and the others share the rest in
    proportion, again and again until no cap binds.
    """
    live = {s: (w, max(0, r) * available.get(s, 0)) for s, (w, r) in targets.items() if w and w > 0 and max(0, r or 0) * available.get(s, 0) > 0}
    use = dict.fromkeys(targets, 0.0)
    if not live:
        return 0.0, use
    if total is None:
        weight = sum(w for w, _ in live.values())
        total = min(cap * weight / w for w, cap in live.values())
    left, open_ = float(total), dict(live)
    while open_:
        weight = sum(w for w, _ in open_.values())
        bound = {s for s, (w, cap) in open_.items() if cap < left * w / weight - 1e-9}
        if not bound:
            use.update({s: left * w / weight for s, (w, _) in open_.items()})
            break
        for s in bound:
            use[s] = float(open_[s][1])
            left -= use[s]
            del open_[s]
    return sum(use.values()), use


def weight_pieces(shares: dict[str, float], schedules: dict[str, tuple[tuple[float, float], ...]]) -> dict[str, list[tuple[float, float, float, float]]]:
    """Of every source, the linear pieces of its weight: (demand before the piece, its begin, weight there, slope).

    At every time the weights add up to the sum of the shares. Schedules that would leave the others less than nothing
    are flattened towards constant weights, all alike and no more than needed.
    """
    live = {s: k for s, k in schedules.items() if shares.get(s)}
    times = sorted({0.0, 1.0, *(float(t) for k in live.values() for t, _ in k)})
    if times[0] < 0 or times[-1] > 1:
        raise ValueError("times of a schedule run from 0 to 1")
    weight = {}
    for s, knots in live.items():
        at, w = zip(*sorted(knots))
        if min(w) < 0 or max(w) <= 0:
            raise ValueError(f"a weight of {s} is below 0")
        w = np.interp(times, at, w)
        weight[s] = w * shares[s] / np.trapezoid(w, times)
    rest = sum(x for s, x in shares.items() if s not in live)
    # flattened as far as the others need it; without others the weights must add up by themselves
    over = sum((w - shares[s] for s, w in weight.items()), np.zeros(len(times)))
    flat = 1.0 if over.max() <= rest + 1e-12 and (rest or np.abs(over).max() < 1e-9) else (rest / over.max() if rest else 0.0)
    weight = {s: shares[s] + flat * (w - shares[s]) for s, w in weight.items()}
    left = rest - flat * over
    out = {}
    for s, share in shares.items():
        w = weight[s] if s in live else np.maximum(left, 0) * (share / rest if rest else 0.0)
        before = np.r_[0.0, np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(times))]
        out[s] = [(float(before[j]), times[j], float(w[j]), float((w[j + 1] - w[j]) / (times[j + 1] - times[j]))) for j in range(len(times) - 1)]
    return out


def _offsets(sized: DataFrame, seed: int, slices: int) -> DataFrame:
    """``sized`` with ``start``: tokens of the source's documents before this one in the random order."""
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = sized.withColumn("draw", order).withColumn("slice", F.shiftrightunsigned("draw", 40) % slices)
    # `slice` need not follow `draw`: the order is (slice, draw, doc_id), random all the same
    sums = rows.groupBy("source", "slice").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "slice").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return at.join(broadcast_if_small(base), ["source", "slice"]).withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner", "slice", "draw")


def training_order(docs: DataFrame, targets: DataFrame, cfg: MixtureConfig = MixtureConfig(), tok: Tokenizer = Tokenizer()) -> tuple[DataFrame, DataFrame]:
    """The mixture and its shares.

    Mixture: (doc_id, use, source, tokens, position), one row for every use of a document, sorted by ``position`` in [0, 1).
    Shares: (source, target_share, max_repeats, available_tokens, used_tokens, actual_share, documents, uses, most_uses),
    one row per target, also for sources without documents. Target names are compared like those of documents; repeated
    target rows add up their shares and take the largest ``max_repeats``; null shares and repeats count as 0.
    Documents without tokens, of a null source or of one that isn't a target, are not used. ``max_repeats`` binds every
    document. Tables without usable rows give an empty mixture.
    """
    spark = docs.sparkSession
    wanted = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("r")).where("source is not null")
    goal = {r["source"]: (r["w"], r["r"]) for r in wanted.orderBy("source").collect()}  # one row per target source
    sized = materialize(token_sizes(docs, tok), "token_sizes")
    used = sized.where((F.col("tokens") > 0) & F.col("source").isin(list(goal)) & F.col("doc_id").isNotNull())
    have = {r["source"]: (r["n"], r["d"]) for r in used.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("d")).collect()}
    total, use = plan_shares({s: n for s, (n, _) in have.items()}, goal, cfg.total)
    shares = {s: n / total if total else 0.0 for s, n in use.items()}
    pieces = weight_pieces(shares, cfg.schedules)
    plan = [(s, float(goal[s][0]), int(goal[s][1]), int(have.get(s, (0, 0))[0]), float(n), pieces[s]) for s, n in use.items()]
    table = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, available_tokens long, demand double, pieces array<struct<before: double, begin: double, weight: double, slope: double>>")
    slices = max([cfg.slices, *(d // cfg.slice_rows for _, d in have.values())])
    placed = _offsets(used, cfg.seed, slices).join(F.broadcast(table), "source")  # one row per target source
    # full epochs, then the documents of the last one up to the demand, to the nearest half document
    full = F.floor(F.col("demand") / F.col("available_tokens") + 1e-12)
    rest = F.col("demand") - full * F.col("available_tokens")
    uses = F.least(F.col("max_repeats"), (full + F.when(F.col("start") + F.col("tokens") / 2 <= rest, 1).otherwise(0)).cast("int"))
    each = placed.withColumn("uses", uses).where("uses > 0").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    c = (F.col("start") + (F.col("use") - 1) * F.col("available_tokens")) / F.lit(total or 1.0)
    # the last piece that begins at or before c; there, weight t + slope t² / 2 = c - before, solved without cancellation
    piece = F.element_at(F.filter("pieces", lambda p: p["before"] <= c), -1)
    rest_c, w, slope = c - piece["before"], piece["weight"], piece["slope"]
    step = F.coalesce(2 * rest_c / F.nullif(w + F.sqrt(F.greatest(F.lit(0.0), w * w + 2 * slope * rest_c)), F.lit(0.0)), F.lit(0.0))
    placed_uses = each.select("doc_id", "use", "source", "tokens", F.least(F.greatest(piece["begin"] + step, F.lit(0.0)), F.lit(1.0)).alias("position"))
    mixture = placed_uses.repartitionByRange(parallelism(spark), "position", "source", "doc_id", "use").sortWithinPartitions("position", "source", "doc_id", "use")
    got = each.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("uses"), F.max("use").alias("most_uses"))
    whole = F.sum("used_tokens").over(Window.partitionBy())  # one row per target source
    zero = {k: 0 for k in ("used_tokens", "documents", "uses", "most_uses")}
    shares = table.join(got, "source", "left").fillna(zero).withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)))
    return mixture, shares.select("source", "target_share", "max_repeats", "available_tokens", "used_tokens", "actual_share", "documents", "uses", "most_uses")
