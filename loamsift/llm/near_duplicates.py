"""Near-duplicate texts by DartMinHash signatures, banding and an exact check.

Darts are thrown at random into the plane weight x rank of every element (a word shingle), at one
dart per unit of area on average and from a hash of the element alone. A text keeps the darts that
fall below its elements' weights and below a rank chosen so that about ``k (ln k + 2)`` of them
remain, throws each into one of ``k`` bins, and of each bin keeps the dart of least rank. Two texts
agree in a bin with a probability equal to their weighted Jaccard similarity, at a cost that grows
with shingles + k ln k rather than with shingles x k.

Every shingle weighs the same here, so the chance that a pair is compared depends on its similarity
alone and not on how many other texts hold what it shares. Texts that share a menu or a notice meet in
bands too; of these pairs, those whose signatures agree too seldom are dropped before sets are sent.
The result rests on the exact Jaccard similarity.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import list_array, map_batches
from .chars import DIGIT, LETTER, blocks, mix
from .checkpoints import cut
from .filters import filter_of, maybe_in

#: Weights lie in (0, 1]; weight cells are [0, 1/64), [1/64, 1/8), [1/8, 1).
_WEIGHT_CELLS = ((0.0, 1 / 64), (1 / 64, 1 / 8), (1 / 8, 1.0))
#: Standard deviations below the threshold at which signatures disagree too much for a pair to be checked.
SLACK = 5.0
#: Classes of a block of a band that many share, and pairs of a class that are checked in one task.
HOT, PAIRS = 256, 64
_U64 = np.uint64


def shingle_sets(texts: list[str | None], words: int):
    """For each block: first text, distinct shingle hashes in order of text, and their number by text."""
    for first, block in blocks([t.lower() if t else t for t in texts]):
        begin, end, text = block.runs(LETTER | DIGIT)
        h = block.hashes(begin, end)
        m = max(0, len(h) - words + 1)
        s = np.zeros(m, _U64)
        with np.errstate(over="ignore"):
            for j in range(words):
                s = mix(s * _U64(0x9E3779B97F4A7C15) + h[j : j + m] + _U64(j + 1))
        whole = text[:m] == text[words - 1 :] if m else np.zeros(0, bool)
        s, owner = s[whole], text[:m][whole]
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        s, owner = s[new], owner[new]
        yield first, s, np.bincount(owner, minlength=len(block.texts))


def set_keys(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set; equal sets have equal keys."""
    sums = np.zeros(len(s) + 1, _U64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(s ^ _U64(0x1B873593)), out=sums[1:])
        at = np.concatenate(([0], np.cumsum(counts)))
        return mix(sums[at[1:]] - sums[at[:-1]] + counts.astype(_U64) * _U64(0xCC9E2D51)).view(np.int64)


@functools.cache
def _poisson_table(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2... darts."""
    p, total, out = float(np.exp(-area)), 0.0, []
    for n in range(40):
        total += p
        out.append(total)
        p *= area / (n + 1)
    return np.array(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U64(11)).astype(np.float64) * 2.0**-53


def _rank_cells(limit: float):
    """[0, 1/64), [1/64, 1/8), [1/8, 1), [1, 2), [2, 4), ... as far as ranks below the limit need."""
    edges = [0.0, 1 / 64, 1 / 8, 1.0]
    while edges[-1] < limit:
        edges.append(edges[-1] * 2)
    return [(lo, hi) for lo, hi in zip(edges, edges[1:]) if lo < limit]


def dart_minhash(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of weighted sets laid end to end: dart ids (sets x k), and which bins hold a dart.

    elements: 64-bit hashes; weights in (0, 1]; counts: elements of each set. A bin stays empty with
    a probability of about e**-2 / k.
    """
    sets = len(counts)
    best = np.zeros(sets * k, _U64)
    held = np.zeros(sets * k, bool)
    if not len(elements):
        return best.reshape(sets, k), held.reshape(sets, k)
    owner = np.repeat(np.arange(sets), counts)
    total = np.bincount(owner, weights, sets)
    limit = np.divide(k * (np.log(k) + 2), total, out=np.zeros(sets), where=total > 0)[owner]
    ranks, homes, darts = [], [], []
    cell = 0
    with np.errstate(over="ignore"):
        for lo, hi in _rank_cells(float(limit.max())):
            live = np.flatnonzero(limit > lo) if lo else np.arange(len(elements))
            for w_lo, w_hi in _WEIGHT_CELLS:
                some = live[weights[live] > w_lo] if w_lo else live
                area = (hi - lo) * (w_hi - w_lo)
                parts = max(1, int(np.ceil(area)))
                table = _poisson_table(area / parts)
                step = (hi - lo) / parts
                for part in range(parts):
                    cell += 1
                    r_lo = lo + part * step
                    if part:
                        some = some[limit[some] > r_lo]
                    if not len(some):
                        break
                    h = mix(elements[some] + _U64(cell * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                    u = _unit(h)
                    hit = u >= table[0]
                    at, h, u = some[hit], h[hit], u[hit]
                    m = 0
                    while len(at):
                        m += 1
                        d = mix(h + _U64(m))
                        e = mix(d)
                        rank = r_lo + step * _unit(d)
                        take = (rank <= limit[at]) & (w_lo + (w_hi - w_lo) * _unit(e) < weights[at])
                        ranks.append(rank[take])
                        homes.append(owner[at[take]] * k + (mix(e[take]) % _U64(k)).astype(np.int64))
                        darts.append(d[take])
                        more = u >= table[m]
                        at, h, u = at[more], h[more], u[more]
    rank, home, dart = np.concatenate(ranks), np.concatenate(homes), np.concatenate(darts)
    order = np.argsort(rank)[::-1]  # the last assignment to a bin is that of least rank
    best[home[order]] = dart[order]
    held[home] = True
    return best.reshape(sets, k), held.reshape(sets, k)


def _sketches(darts: np.ndarray) -> np.ndarray:
    """Two bits of each dart of a signature, packed into 64-bit words: equal darts agree in both, others in each by chance."""
    h = mix(darts)
    bits = np.stack([(h >> _U64(j)) & _U64(1) for j in (3, 7)], axis=2).astype(np.uint8).reshape(len(darts), 2 * darts.shape[1])
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1).view(np.int64)


def _pack(s: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each set as its members' low 40 bits in ascending order, five bytes each."""
    s = s & _U64((1 << 40) - 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    s = s[np.lexsort((s, owner))]
    raw = s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    at = np.concatenate(([0], np.cumsum(counts))) * 5
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two packed sets."""
    x, y = len(a) // 5, len(b) // 5
    both = np.concatenate((_unpack(a), _unpack(b)))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (x + y - same) if x + y else 0.0


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, and the links between classes.

    Returns members (``id_col``, class) and links (class_a, class_b, similarity), each pair once,
    for all pairs of classes that share a band and whose Jaccard similarity reaches the threshold.
    Null and empty texts, and those of fewer than ``words`` words, have no shingles and are in no
    class. Ids need not be unique (equal rows stay equal rows).
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null and _text <> ''")
    k = bands * rows
    def keyed():
        def each(batch):
            ids = batch.column(0)
            for first, s, counts in shingle_sets(batch.column(1).to_pylist(), words):
                some = pa.array(counts > 0)
                yield {"_id": ids.slice(first, len(counts)).filter(some), "class": pa.array(set_keys(s, counts)).filter(some)}

        return each

    members = cut(map_batches(docs, keyed, f"_id {docs.schema['_id'].dataType.simpleString()}, class long").withColumnRenamed("_id", id_col))
    words64 = -(-2 * k // 64)
    spread = (1 - threshold) * k
    most_bits = spread + SLACK * (threshold * spread + spread / 2) ** 0.5
    least_darts = threshold * k - SLACK * (threshold * spread) ** 0.5

    def signed():
        def each(batch):
            for _, s, counts in shingle_sets(batch.column(0).to_pylist(), words):
                darts, held = dart_minhash(s, np.ones(len(s)), counts, k)
                with np.errstate(over="ignore"):
                    band = np.zeros((len(counts), bands), _U64)
                    for j in range(rows):
                        band = mix(band * _U64(31) + darts[:, j::rows])
                    band = mix(band + np.arange(bands, dtype=_U64))
                full = np.logical_and.reduce([held[:, j::rows] for j in range(rows)])
                some = np.flatnonzero(full.any(axis=1))
                sketch = _sketches(darts[some])
                low = darts[some].astype(np.uint8)
                columns = {f"w{j}": sketch[:, j] for j in range(words64)} | {"darts": [x.tobytes() for x in low]}
                yield columns | {"class": set_keys(s, counts)[some], "size": counts[some], "bands": list_array(band[some][full[some]].view(np.int64), full[some].sum(axis=1), pa.int64())}

        return each

    ws = [f"w{j}" for j in range(words64)]
    ddl = "class long, size int, darts binary, bands array<long>, " + ", ".join(f"{w} long" for w in ws)
    signatures = cut(map_batches(docs.select("_text"), signed, ddl).dropDuplicates(["class"]))
    banded = signatures.select("class", "size", *ws, F.explode("bands").alias("band"))
    # a band that few share is joined as it is; of one that many share blocks of HOT classes meet block by block
    shared = banded.withColumn("_n", F.count("*").over(Window.partitionBy("band"))).where("_n > 1")
    side = lambda df, s, *keys: df.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("class", "size", *ws)))
    cold = shared.where(F.col("_n") <= HOT)
    hot = shared.where(F.col("_n") > HOT).withColumn("_parts", F.ceil(F.col("_n") / HOT).cast("int")).withColumn("_own", F.pmod(F.hash("class"), F.col("_parts")))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = side(hot.withColumn("_part_b", every).withColumnRenamed("_own", "_part_a"), "a", "band", "_part_a", "_part_b")
    right = side(hot.withColumn("_part_a", every).withColumnRenamed("_own", "_part_b"), "b", "band", "_part_a", "_part_b")
    # the smaller set of a pair is a: its members are what travels to the other
    fits = (F.struct("size_a", "class_a") < F.struct("size_b", "class_b")) & (F.col("size_a") >= F.col("size_b") * F.lit(threshold) - 1e-9)
    differ = functools.reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in ws))
    near = lambda joined: joined.where(fits & (differ <= most_bits)).select("class_a", "class_b")
    candidates = near(side(cold, "a", "band").join(side(cold, "b", "band"), "band")).unionByName(near(left.join(right, ["band", "_part_a", "_part_b"]))).distinct()
    darts = signatures.select("class", "darts")
    candidates = candidates.join(darts.toDF("class_a", "darts_a"), "class_a").join(darts.toDF("class_b", "darts_b"), "class_b").select("class_a", "class_b", "darts_a", "darts_b")

    def agreeing():
        def each(batch):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, k) for i in (2, 3))
            good = pa.array((x == y).sum(axis=1) >= least_darts)
            yield {"class_a": batch.column(0).filter(good), "class_b": batch.column(1).filter(good)}

        return each

    candidates = cut(map_batches(candidates, agreeing, "class_a long, class_b long"))
    # only sets that are in a candidate pair are packed and sent
    wanted = docs.sparkSession.sparkContext.broadcast(filter_of(candidates.select(F.explode(F.array("class_a", "class_b")).alias("class")), "class"))

    def packed():
        bits = wanted.value

        def each(batch):
            for _, s, counts in shingle_sets(batch.column(0).to_pylist(), words):
                keys = set_keys(s, counts)
                some = (counts > 0) & maybe_in(bits, keys.view(_U64))
                raw = _pack(s[np.repeat(some, counts)], counts[some])
                yield {"class": keys[some], "members": raw}

        return each

    sets = map_batches(docs.select("_text"), packed, "class long, members binary").groupBy("class").agg(F.first("members").alias("members"))
    # a class in many pairs is spread over several tasks, PAIRS of them in each
    parts = candidates.groupBy("class_b").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("_parts"))
    spread = candidates.join(parts, "class_b").select("class_a", "class_b", F.pmod(F.hash("class_a"), F.col("_parts")).alias("_part"))
    sets_b = sets.select(F.col("class").alias("class_b"), F.col("members").alias("members_b")).join(parts, "class_b")
    sets_b = sets_b.select("class_b", "members_b", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    pairs = (
        spread.join(sets.select(F.col("class").alias("class_a"), F.col("members").alias("members_a")), "class_a")
        .join(sets_b, ["class_b", "_part"])
        .select("class_a", "class_b", "members_a", "members_b")
    )

    def checked():
        def each(batch):
            similarity = np.array([jaccard(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])
            good = np.flatnonzero(similarity >= threshold - 1e-12)
            yield {"class_a": batch.column(0).take(pa.array(good)), "class_b": batch.column(1).take(pa.array(good)), "similarity": similarity[good]}

        return each

    return members, map_batches(pairs, checked, "class_a long, class_b long, similarity double")


def near_duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of rows in one class or in linked classes; see near_duplicate_classes."""
    members, links = near_duplicate_classes(docs, id_col, text_col, **how)
    one, two = members.select(F.col(id_col).alias("id_a"), F.col("class").alias("class_a")), members.select(F.col(id_col).alias("id_b"), F.col("class").alias("class_b"))
    within = one.join(two, F.col("class_a") == F.col("class_b")).where("id_a < id_b").select("id_a", "id_b")
    across = links.join(one, "class_a").join(two, "class_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return within.unionByName(across).where("id_a <> id_b").distinct()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that can be reached over the links, by rounds of hooking to the least neighbour and pointer jumping."""
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("near"))
        hooked = label.join(near.withColumnRenamed("u", "node"), "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("far"))
        new = cut(hooked.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("component"), F.col("component").alias("old")))
        changed = new.where("component <> old").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, group, links): group is one class key for all texts joined by a chain of links; links counts the other classes linked to a row's class."""
    members, links = near_duplicate_classes(docs, id_col, text_col, **how)
    links = cut(links.select("class_a", "class_b"))
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    group = connected(links, "class_a", "class_b").withColumnRenamed("node", "class").withColumnRenamed("component", "group")
    return members.join(degree, "class", "left").join(group, "class", "left").select(id_col, F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
