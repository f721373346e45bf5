"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing.

Fingerprints that differ in at most three bits meet at a variant within half that radius of
both. Every fingerprint emits its variants of at most one flipped bit (65); those of even
parity also emit variants of two flipped bits in the same half of the word (992). That covers all links: one or two
differing bits meet in the middle; of three, two lie in the same half, the even one
flips these and the odd one the third. Everything that reaches a variant is within three bits of
what reaches it by at most one flip, so a variant links its members to the smallest such
fingerprint, instead of all pairs, and distances are verified. A variant has 1,057 members at most.

Equal fingerprints are grouped first. Only fingerprints that can have a link emit their ball: two
within three bits agree in at least five of their eight bytes, so one that shares no five
bytes with another (56 keys each, counted before they are joined) has none. The joins on variants are sort-merge
joins by hint: Spark estimates exploded rows by their source and would broadcast them. Components are found over
edges (a number of rows in proportion to the fingerprints).

For a similarity (``one_of_each``) 64 bits and three flips are too few: texts whose 5-word shingles have a
Jaccard similarity of 0.8 differ in about ten bits. There ball hashing comes first, on the fingerprints of the shingle sets, and its links are
verified on the sets, as 64-bit hashes. An exact search follows for what it can't reach: in one order of all shingles, sets of
at least this similarity share a shingle of their first fifth (prefix filter), and pairs that share one are verified. Hubs link large groups, then rounds of closest sketches (as in a spanning forest); pairs that are still unconnected are all verified. Before sets are fetched, parity sketches
rule out pairs that can't be similar (never one that is); where many unconnected members share a shingle they are compared in blocks within tasks.

Defined cases: a null or empty text has fingerprint zero and links like any other; a null id
gets a component like others and counts as larger than all ids; rows that repeat each get a result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, pick, settle, text_of, written
from .components import connected_components, joined_components

BITS, RADIUS, BYTES_AGREE = 64, 3, 5


def majority_bits(hashes: list[int] | np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        raw = np.array(hashes[at : at + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The bits set in over half of the XXH64 (seed 42) of the word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: n - 1].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return majority_bits(hashes)


def fingerprints(docs: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """id, fp (the fingerprint as a signed long) for every row."""
    rows = pick(docs, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fps)], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp long")


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips() -> tuple[list[int], list[int]]:
    """Masks of at most one bit, and of two bits in one half."""
    one = [0, *(1 << i for i in range(BITS))]
    two = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    return [*map(_as_long, one)], [*map(_as_long, two)]


def _long_array(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def may_link(fps: DataFrame) -> DataFrame:
    """The fingerprints (column fp, distinct) that share five bytes with another."""
    masks = [_as_long(sum(0xFF << 8 * b for b in kept)) for kept in combinations(range(8), BYTES_AGREE)]
    keys = fps.select("fp", F.posexplode(_long_array(masks)).alias("which", "mask")).select("fp", F.xxhash64("which", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keys.join(shared.hint("merge"), "key", "left_semi").select("fp").distinct()


def ball_edges(fps: DataFrame) -> DataFrame:
    """(u, v): verified links between distinct fingerprints, enough to connect all that are within three bits."""
    one, two = _flips()
    # a small table makes many rows: they are made by as many tasks as a shuffle has
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    near = fps.select("fp", F.explode(_long_array(one)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    even = fps.where(F.bit_count("fp") % 2 == 0)
    far = even.select("fp", F.explode(_long_array(two)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    hubs = near.groupBy("variant").agg(F.min("fp").alias("hub"))
    met = near.unionByName(far).join(hubs.hint("merge"), "variant").where("fp <> hub").select("fp", "hub").distinct()
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS).select(F.col("fp").alias("u"), F.col("hub").alias("v"))


def near_duplicates(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable) for every row."""
    every, _ = written(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    kind = every.schema["id"].dataType.simpleString()
    groups = every.groupBy("fp").agg(F.min("id").alias("least"))
    edges, _ = written(ball_edges(written(may_link(groups.select("fp")), "may-link")[0]), "ball-edges")
    parts = connected_components(edges)
    ids = parts.join(groups.withColumnRenamed("fp", "node"), "node")
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    linked, _ = written(parts.join(least, "component").select(F.col("node").alias("fp"), "component_id"), "linked")
    # written, so that the join reads an exchange on both sides and Spark can split a hot fingerprint
    named, _ = written(groups.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").cast(kind).alias("component_id")), "named")
    out = every.join(named, "fp")
    return out.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity instead of a fixed radius ---------------------------------------------------

#: One document in so many is read for the frequent shingles: those of at least so many of them, so many at most.
SAMPLED, FREQUENT, MOST_FREQUENT = 10, 2, 1 << 19
#: Rounds of hubs before the pairs that are left are made.
HUB_ROUNDS = 2
#: Hubs that a set meets in a round, those with which it shares most; what it has in common with others is left to the pairs.
BEST_HUBS = 3
#: Bits of a parity sketch: how often, odd or even, the hashes of a set begin with each of the numbers below it.
SKETCH_BITS = 2048
#: Keys whose members would make more pairs than this are compared in blocks of so many members.
HOT_PAIRS, BLOCK = 4096, 2048


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of the word shingles, in order; of the whole text if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1 if n > 1 else np.array([len(joined)])
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[len(ends) - n :].tolist(), strict=True)]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the word shingles, ascending."""
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def _digest(hashes: np.ndarray) -> int:
    """A set of hashes as one signed long, never negative."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) >> 1


def text_hash(column: str | Column) -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64(text_of(column))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits as longs. Those in which two sketches differ are no more than the hashes that one set alone has, whatever the sets share."""
    odd = np.bincount((hashes >> np.uint64(65 - SKETCH_BITS.bit_length())).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_apart(similarity: float) -> float:
    """Of the hashes of two sets together, the share that may stand in one alone."""
    return (1 - similarity) / (1 + similarity)


def frequent_shingles(docs: DataFrame, shingle: int, text_column: str) -> np.ndarray:
    """Hashes of shingles that are frequent in a tenth of the documents, ascending by frequency.

    They only decide the order in which shingles are compared: any order gives the same links, a good one fewer pairs.
    """
    some = pick(docs, text=text_column).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"]:
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle).view(np.int64))], names=["hash"])

    often = some.mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = often.orderBy(F.desc("n"), "hash").limit(MOST_FREQUENT).toArrow()
    return top["hash"].to_numpy()[::-1].copy()


def prefixes(docs: DataFrame, shingle: int, similarity: float, frequent: np.ndarray, id_column: str, text_column: str) -> DataFrame:
    """id, h (a hash of the text), node (a digest of the shingle set), size (of the set), prefix (its first hashes in one order of all shingles), bits (its sketch), fp (its fingerprint) for every row.

    Two sets that are similar enough share a hash of their prefixes: a prefix leaves out fewer hashes than any such pair shares.
    The order is by hash, with the frequent shingles last.
    """
    rows = pick(docs, id=id_column, text=text_column).select("id", text_hash("text").alias("h"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    by_hash = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                nodes, sizes, first, bits, fps = [], [], [], [], []
                for text in piece["text"]:
                    hashes = shingle_set(text.as_py(), shingle)
                    bits.append(parity_sketch(hashes))
                    fps.append(_as_long(majority_bits(hashes)))
                    nodes.append(_digest(hashes))
                    sizes.append(len(hashes))
                    hashes = hashes.view(np.int64)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                        hit = known[place] == hashes
                        last = np.flatnonzero(hit)
                        hashes = np.concatenate([hashes[~hit], hashes[last[np.argsort(rank[place[last]])]]])
                    first.append(hashes[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1])
                yield pa.RecordBatch.from_arrays([piece["id"], piece["h"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=["id", "h", "node", "size", "prefix", "bits", "fp"])

    return rows.mapInArrow(run, f"id {kind}, h long, node long, size int, prefix array<bigint>, bits array<bigint>, fp long")


def shared_keys(every: DataFrame) -> DataFrame:
    """key, node, size for the hashes of prefixes that more than one node has, distinct. every: node, size, prefix."""
    keys = every.select("node", "size", F.explode("prefix").alias("key"))
    of_key = keys.groupBy("key").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p <> q")
    # written, so that the join reads an exchange on both sides and Spark can split a hot key
    several, path = written(of_key.select("key"), "several-nodes")
    shared, _ = written(keys.join(several.hint("merge"), "key", "left_semi").select("key", "node", "size").distinct(), "shared-keys")
    dropped(every.sparkSession, path)
    return shared


def likely(met: DataFrame, similarity: float, part: float, best: int | None = None) -> DataFrame:
    """(node, hub) of met (node, size, hub, hub_size; a row for each common hash of their prefixes) that can be similar enough.

    One set has at least ``similarity`` times the hashes of the other.     Hashes that two sets share stand in both prefixes, or in one of the sets after its prefix: the first are counted, the
    others are as many as there are at most. With a part below one, so much of the needed count is enough; with ``best`` a node keeps so many hubs.
    """
    near = F.least("size", "hub_size") >= F.greatest("size", "hub_size") * similarity - 1e-9
    counted = met.where(near).groupBy("node", "hub", "size", "hub_size").agg(F.count("*").alias("n"))
    rest = F.greatest(*[F.ceil(F.col(c) * similarity - 1e-9) - 1 for c in ("size", "hub_size")])
    needed = (F.col("size") + F.col("hub_size")) * (similarity / (1 + similarity)) - rest - 1e-6
    enough = counted.where(F.col("n") >= needed * part)
    if best:
        turn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "hub"))
        enough = enough.withColumn("_turn", turn).where(F.col("_turn") <= best)
    return enough.select("node", "hub")


def hub_pairs(parted: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(node, hub): for each key its members and one of them, chosen by a hash of this turn, in different parts."""
    chosen = F.min_by(F.struct("node", "size", "part"), F.struct(F.xxhash64("node", F.lit(turn)), "node"))
    hubs = parted.groupBy("key").agg(chosen.alias("h"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    hubs, _ = written(hubs.select("key", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.part").alias("hub_part")), "hubs")
    # a key may have another hub, so not all common hashes are counted
    return likely(parted.join(hubs.hint("merge"), "key").where("part <> hub_part"), similarity, 0.3, BEST_HUBS)


def in_parts(keys: DataFrame, parts: DataFrame | None) -> DataFrame:
    """keys with part: the component of the node by parts (node, component), the node itself without one."""
    if parts is None:
        return keys.withColumn("part", F.col("node"))
    joined = keys.join(parts.withColumnRenamed("component", "part"), "node", "left")
    return joined.select("key", "node", "size", F.coalesce("part", "node").alias("part"))


def several_parts(keys: DataFrame, parts: DataFrame | None) -> DataFrame:
    """key, node, size, part, large (the largest part of the key), members, others (those outside it), hot: of the keys whose members are in several parts."""
    parted = in_parts(keys, parts)
    of_part = parted.groupBy("key", "part").agg(F.count("*").alias("n"))
    per = of_part.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("large"), F.count("*").alias("parts"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("others"))
    large, _ = written(per.where("parts > 1").select("key", "large", "members", "others"), "largest-parts")
    return written(parted.join(large.hint("merge"), "key").withColumn("hot", F.col("members") * F.col("others") > HOT_PAIRS), "several-parts")[0]


def left_pairs(some: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(node, hub): all pairs of a key of some that may be similar and are in different parts, by their sketches too.

    The members of a key outside its largest part meet all of its members, so a large part does not meet itself. Pairs that share a key of
    many such members are compared there, in blocks by their sketches; the others by the hashes that they share.
    """
    cold = some.where("NOT hot")
    few = cold.where("part <> large").select("key", F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("part").alias("hub_part"))
    met = cold.join(few.hint("merge"), "key").where("part <> hub_part AND (part = large OR node < hub)")
    # one row for each common hash, whichever of the two is in the largest part of the key
    pair = F.array_sort(F.array(F.struct("node", "size"), F.struct(F.col("hub").alias("node"), F.col("hub_size").alias("size"))))
    ordered = met.select(pair.alias("x")).select(F.col("x")[0]["node"].alias("node"), F.col("x")[0]["size"].alias("size"), F.col("x")[1]["node"].alias("hub"), F.col("x")[1]["size"].alias("hub_size"))
    return near_sketches(likely(ordered, similarity, 1), sketches, similarity).unionByName(block_pairs(some.where("hot"), sketches, similarity)).distinct()


def closest_pairs(some: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(node, hub): for each node of a hot key the one of another part whose sketch is the closest, if it is near enough."""
    near = block_pairs(some.where("hot"), sketches, similarity, closest=True)
    best = near.groupBy("node").agg(F.min_by("hub", F.struct("far", "hub")).alias("hub"))
    return best.select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub")).distinct()


def block_pairs(some: DataFrame, sketches: DataFrame, similarity: float, closest: bool = False) -> DataFrame:
    """(node, hub) of the keys of some (key, node, size, part, large, members, others) whose sketches are near enough, compared block by block.

    With ``closest`` a node outside the largest part gets its closest of each block alone, with far: the share of their hashes in which the sketches differ.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    # each row gets its node's sketch: a node has as many rows as its prefix has hashes, so no window is hot
    bits = F.first("bits", ignorenulls=True).over(Window.partitionBy("node"))
    rows = some.unionByName(sketches.select("node", "bits"), allowMissingColumns=True).withColumn("bits", bits).where("key IS NOT NULL")
    own = F.pmod(F.xxhash64("node"), blocks("members"))
    other = F.pmod(F.xxhash64("node", F.lit(1)), blocks("others"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    columns = ["key", "node", "size", "part", "large", "bits"]
    every = rows.select(*columns, F.lit(False).alias("asks"), own.alias("i"), spread("others").alias("j"))
    asks = rows.where("part <> large").select(*columns, F.lit(True).alias("asks"), spread("members").alias("i"), other.alias("j"))
    share = most_apart(similarity)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        found, shares = [], []
        if len(a) and len(b):
            x, y = (np.array(t["bits"].tolist(), np.int64).view(np.uint64) for t in (a, b))
            node, size, part = (b[c].to_numpy() for c in ("node", "size", "part"))
            in_large = part == int(b["large"].iloc[0])
            for at, (n, m, p) in enumerate(zip(a["node"].tolist(), a["size"].tolist(), a["part"].tolist(), strict=True)):
                near = np.flatnonzero((part != p) & (closest | in_large | (node < n)) & (np.minimum(size, m) >= np.maximum(size, m) * similarity - 1e-9))
                apart = np.bitwise_count(y[near] ^ x[at]).sum(1, dtype=np.int64)
                fits = apart <= share * (size[near] + m) + 1e-6
                hit, far = near[fits], apart[fits] / np.maximum(size[near][fits] + m, 1)
                if closest:
                    if len(hit):
                        k = np.lexsort((node[hit], far))[0]
                        found.append(np.array([[n, node[hit[k]]]]))
                        shares.append(far[k])
                    continue
                found.append(np.stack([np.minimum(node[hit], n), np.maximum(node[hit], n)], 1))
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        out = pd.DataFrame({"node": pairs[:, 0], "hub": pairs[:, 1]})
        return out.assign(far=np.array(shares, float)) if closest else out

    return every.unionByName(asks).groupBy("key", "i", "j").applyInPandas(compare, "node long, hub long" + ", far double" * closest)


def near_sketches(met: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs of met whose sketches differ in no more bits than sets of this similarity can."""
    hubs = sketches.select(F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("bits").alias("hub_bits"))
    both = met.join(sketches, "node").join(hubs, "hub")
    apart = F.aggregate(F.zip_with("bits", "hub_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.where(apart <= most_apart(similarity) * (F.col("size") + F.col("hub_size")) + 1e-6).select("node", "hub")


def shingle_sets(docs: DataFrame, shingle: int, text_column: str) -> DataFrame:
    """node, hashes (the distinct hashes of its shingles) for every row."""
    rows = pick(docs, text=text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t.as_py(), shingle) for t in batch.slice(at, 256)["text"]]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes array<bigint>")


def verified(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs of met whose shingle sets have at least this Jaccard similarity."""
    both = met.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("hashes").alias("hub_hashes")), "hub")
    shared = F.size(F.array_intersect("hashes", "hub_hashes"))
    return both.where(shared * (1 + similarity) >= similarity * (F.size("hashes") + F.size("hub_hashes")) - 1e-9).select(F.col("node").alias("u"), F.col("hub").alias("v"))


def ball_pairs(sketches: DataFrame, similarity: float) -> DataFrame:
    """(node, hub): sets that ball hashing links by their fingerprints, and those of one fingerprint with the least of them. sketches: node, size, bits, fp."""
    groups, groups_path = written(sketches.groupBy("fp").agg(F.min("node").alias("hub")), "ball-groups")
    some, some_path = written(may_link(groups.select("fp")), "may-link")
    of = lambda fp, name: groups.select(F.col("fp").alias(fp), F.col("hub").alias(name))
    across = ball_edges(some).join(of("u", "node"), "u").join(of("v", "hub"), "v").select("node", "hub")
    equal = sketches.select("node", "fp").join(groups, "fp").where("node <> hub").select("node", "hub")
    pairs, _ = written(near_sketches(across.unionByName(equal), sketches, similarity), "ball-pairs")
    for path in (groups_path, some_path):
        dropped(sketches.sparkSession, path)
    return pairs


def similar_parts(keys: DataFrame, sketches: DataFrame, sets_of, similarity: float) -> DataFrame:
    """(node, component) by verified links, enough to connect all nodes that are similar enough. ``sets_of(met)`` gives the sets of the nodes of pairs.

    Ball hashing links what its fingerprints tell. The rest is exact: rounds of hubs link large groups by few pairs. Where a shingle has many members that are still unconnected, each is then linked to the closest by its
    sketch, in rounds for as long as most of these pairs are links: each round leaves a few of the pairs that stood between parts, so pairs of one group do
    not all have to be verified. What is left unconnected meets in all pairs, so no link is missed.
    """
    spark = keys.sparkSession
    parts = None

    def linked(met: DataFrame) -> tuple[int, int]:
        """Verifies the pairs and joins the parts that their links connect; the number of both."""
        nonlocal parts
        met, met_path = written(met, "met")
        asked = links = met.count()
        if asked:
            sets, sets_path = sets_of(met)
            new, new_path = written(verified(met, sets, similarity), "similar-edges")
            dropped(spark, sets_path)
            if links := new.count():
                parts = joined_components(parts, new)
            dropped(spark, new_path)
        dropped(spark, met_path)
        settle(spark)
        return asked, links

    linked(ball_pairs(sketches, similarity))
    for turn in range(HUB_ROUNDS):
        linked(near_sketches(hub_pairs(in_parts(keys, parts), similarity, turn), sketches, similarity))
    some = several_parts(keys, parts)
    settle(spark)
    asked = links = 1
    while 2 * links > asked:
        asked, links = linked(closest_pairs(some, sketches, similarity))
        if links:
            some = several_parts(keys, parts)
            settle(spark)
    linked(left_pairs(some, sketches, similarity))
    return parts if parts is not None else sketches.limit(0).select("node", F.col("node").alias("component"))


def similar_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, h, component_id) of the rows, by id and hash of their text, that are not the smallest of their component."""
    some = docs.where(F.col(id_column).isNotNull())
    every, path = written(prefixes(some, shingle, similarity, frequent_shingles(some, shingle, text_column), id_column, text_column), "prefixes")
    keys = shared_keys(every)
    nodes, _ = written(every.groupBy("node").agg(F.min(F.struct("id", "h")).alias("least")), "nodes")
    sketches, sketches_path = written(every.groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fp").alias("fp")), "sketches")
    ids, _ = written(every.select("id", "h", "node"), "node-ids")
    dropped(docs.sparkSession, path)
    settle(docs.sparkSession)

    def sets_of(met: DataFrame) -> tuple[DataFrame, str]:
        both = met.select("node").unionByName(met.select(F.col("hub").alias("node"))).distinct()
        wanted, _ = written(nodes.join(both, "node").select(F.col("least.id").alias("_id"), F.col("least.h").alias("_h")), "wanted")
        rows = pick(some, _id=id_column, _text=text_column).withColumn("_h", text_hash("_text"))
        return written(shingle_sets(rows.join(wanted, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"]), shingle, "_text"), "sets")

    parts = similar_parts(keys, sketches, sets_of, similarity)
    dropped(docs.sparkSession, sketches_path)
    least = parts.join(nodes, "node").groupBy("component").agg(F.min("least").alias("top"))
    linked = parts.join(least, "component").select("node", "top")
    named, _ = written(nodes.join(linked, "node", "left").select("node", F.coalesce("top", "least").alias("top")), "named")
    return ids.join(named, "node").where(F.struct("id", "h") > F.col("top")).select("id", "h", F.col("top.id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that are the smallest of their component by id (by a hash of the text if the id is shared), with all their columns.

    Rows with a null id stay: nothing tells which of them to keep. Rows that repeat id and text stay or go together.
    """
    copies = similar_copies(pick(docs, **{id_column: id_column, text_column: text_column}), shingle, similarity, id_column, text_column)
    extra, _ = written(copies.select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct(), "near-copies")
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    the_id, text = (F.col(f"_c{docs.columns.index(c)}") for c in (id_column, text_column))
    return flat.join(extra, (the_id == F.col("_id")) & (text_hash(text) == F.col("_h")), "left_anti").toDF(*docs.columns)
