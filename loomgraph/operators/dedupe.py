"""Near-duplicate labels: blocked similarity, components, edge rewiring.

The result only needs the connected components of the "similar" relation, so
no step lists all pairs of a group:

1. equal normal forms meet in one aggregation and stand for a single label;
2. labels that agree but for their last characters are tied to one
   representative per prefix, which collapses runs such as numbered names; what was
   tied is tied again by its representative and a longer tail, as long as that finds links;
3. what is left is compared block by block, only across components. Members of a
   block's largest component meet the others but not each other. Blocks are
   cut into chunks of bounded size, one task per pair of chunks, and a task
   returns a spanning forest of what it found rather than the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import fixed, text
from loomgraph.functions.similarity import jaro_winkler, jaro_winkler_pair
from loomgraph.operators.assemble import pair_keys
from loomgraph.operators.components import connected_components
from loomgraph.session import cut

SMALL_BLOCK = 32  # blocks up to this size are joined with themselves
CHUNK = 800  # larger blocks are compared in chunk pairs of this size
TAIL = 3  # last characters that one round of ties lets differ


def label_forms(nodes: DataFrame, plain: bool = False) -> DataFrame:
    """One row per normal form: representative, and whether a non-code node carries it."""
    return (
        nodes.withColumn("norm", text.merge_norm("label", plain))
        .where(F.length("norm") >= fixed.MERGE_MIN_CHARS)
        .groupBy("norm")
        .agg(
            F.min_by("id", "ord").alias("rep"),
            F.max(F.col("file_type") != "code").alias("open"),
        )
    )


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Keep (na, nb, a, b) pairs that are similar; cheap length test first."""
    la, lb = F.length("na"), F.length("nb")
    floor = 3 * (threshold - 0.4) / 0.6 - 2
    plausible = F.least(la, lb) >= F.greatest(la, lb) * floor - 1e-9
    return pairs.where(plausible).where(jaro_winkler("na", "nb") >= threshold).select("a", "b")


def _tail_links(forms: DataFrame, threshold: float, tails: range) -> DataFrame:
    """Tie each label to one representative of the labels sharing all but its tail."""
    size = F.length("norm")
    keys = F.array(
        *[F.when(size - t >= fixed.MERGE_BLOCK_CHARS, F.concat(F.lit(f"{t}:"), F.left("norm", size - t))) for t in tails]
    )
    keyed = forms.select("norm", "rep", "open", F.explode(F.array_compact(keys)).alias("tail_key"))
    heads = keyed.groupBy("tail_key").agg(F.min(F.struct(~F.col("open"), F.col("norm"), F.col("rep"))).alias("h"))
    heads = heads.select("tail_key", F.col("h.norm").alias("nb"), F.col("h.rep").alias("b"), (~F.col("h.col1")).alias("open_b"))
    pairs = (
        keyed.join(heads, "tail_key")
        .where((F.col("rep") != F.col("b")) & (F.col("open") | F.col("open_b")))
        .select(F.col("norm").alias("na"), F.col("rep").alias("a"), "nb", "b")
        .distinct()
    )
    return _verified(pairs, threshold)


def _placed(forms: DataFrame, links: DataFrame) -> DataFrame:
    """Forms with their component by the links found so far."""
    comps = connected_components(links).withColumnRenamed("id", "rep")
    return forms.join(comps, "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")


def _ties(forms: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, forms with their component): ties over longer and longer tails.

    After the first round only the least label of each component goes on, so every
    round reads what the one before it left over, and a long run of numbered names
    becomes one component without meeting itself.
    """
    links = cut(_tail_links(forms, threshold, range(1, 1 + TAIL)))
    placed = cut(_placed(forms, links))
    at = 1 + TAIL
    while True:
        least = placed.groupBy("comp").agg(F.min(F.struct((~F.col("open")).alias("closed"), "norm", "rep")).alias("m"))
        heads = least.select("m.norm", "m.rep", (~F.col("m.closed")).alias("open"))
        more = cut(_tail_links(heads, threshold, range(at, at + TAIL)))
        if more.isEmpty():
            return links, placed
        links = links.unionByName(more)
        placed = cut(_placed(forms, links))
        at += TAIL


def _blocks(forms: DataFrame) -> DataFrame:
    """Members of the blocks that still span components; ``main`` ones are of the block's largest."""
    n = fixed.MERGE_BLOCK_CHARS
    keys = F.array_distinct(F.array(F.left("norm", F.lit(n)), F.right("norm", F.lit(n))))
    rows = forms.select("norm", "rep", "open", "comp", F.explode(keys).alias("block"))
    sizes = rows.groupBy("block", "comp").agg(F.count("*").alias("n"), F.max("open").alias("open"))
    stats = sizes.groupBy("block").agg(
        F.sum("n").alias("n"), F.max("n").alias("n_main"), F.max_by("comp", F.struct("n", "comp")).alias("largest"),
        F.count("*").alias("comps"), F.max("open").alias("any_open"),
    )
    stats = stats.where((F.col("comps") > 1) & F.col("any_open")).drop("comps", "any_open")
    return rows.join(stats, "block").withColumn("main", F.col("comp") == F.col("largest")).drop("largest")


def _small_block_links(blocks: DataFrame, threshold: float) -> DataFrame:
    small = blocks.where(F.col("n") <= SMALL_BLOCK)
    a = small.select("block", F.col("norm").alias("na"), F.col("rep").alias("a"), F.col("open").alias("oa"), F.col("comp").alias("ca"))
    b = small.select("block", F.col("norm").alias("nb"), F.col("rep").alias("b"), F.col("open").alias("ob"), F.col("comp").alias("cb"))
    pairs = a.join(b, "block").where((F.col("na") < F.col("nb")) & (F.col("ca") != F.col("cb")) & (F.col("oa") | F.col("ob")))
    return _verified(pairs.select("na", "a", "nb", "b").distinct(), threshold)


def forest_of_chunk(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Spanning links between components inside one pair of chunks.

    A candidate has to pass two exact upper bounds (length ratio and shared
    characters) before it is scored. Members of the block's largest component come
    last and look for nobody: all others look at them.
    """
    pdf = pdf.sort_values(["main", "norm"], kind="stable").reset_index(drop=True)
    seeking = int((~pdf["main"].to_numpy(bool)).sum())
    norms, reps = pdf["norm"].tolist(), pdf["rep"].tolist()
    comp = pd.factorize(pdf["comp"])[0]
    is_open, side = pdf["open"].to_numpy(bool), pdf["side"].to_numpy()
    size = np.array([len(x) for x in norms], dtype=np.float64)
    alphabet = {ch: k for k, ch in enumerate(sorted(set("".join(norms))))}
    bag = np.zeros((len(norms), len(alphabet)), dtype=np.int16)
    for i, word in enumerate(norms):
        for ch in word:
            bag[i, alphabet[ch]] += 1
    jaro_floor = (threshold - 0.4) / 0.6
    crossing = side.min() != side.max()
    links = []
    for i in range(min(seeking, len(norms) - 1)):
        rest = slice(i + 1, None)
        mask = (comp[rest] != comp[i]) & (is_open[rest] | is_open[i])
        if crossing:
            mask &= side[rest] != side[i]
        at = np.flatnonzero(mask) + i + 1
        if not len(at):
            continue
        shared = np.minimum(bag[at], bag[i]).sum(axis=1)
        bound = (shared / size[i] + shared / size[at] + 1) / 3
        for j in at[bound >= jaro_floor - 1e-9]:
            if comp[j] != comp[i] and jaro_winkler_pair(norms[i], norms[j]) >= threshold:
                links.append((reps[i], reps[j]))
                comp[comp == comp[j]] = comp[i]
    return pd.DataFrame(links, columns=["a", "b"], dtype=object)


def _large_block_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """Chunks of the members outside the largest component meet each other and the chunks of that component."""
    large = blocks.where(F.col("n") > SMALL_BLOCK)
    whole = F.col("n") <= CHUNK
    outer = F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("n_main")) / CHUNK)).cast("int")
    inner = F.when(whole, 0).otherwise(F.ceil(F.col("n_main") / CHUNK)).cast("int")
    large = large.withColumns({"outer": outer, "inner": inner})
    own = F.col("main") & ~whole
    among = F.pmod(F.xxhash64("norm"), F.when(own, F.col("inner")).otherwise(F.col("outer"))).cast("int")
    large = large.withColumn("side", F.when(own, F.col("outer")).otherwise(0) + among)
    last = F.when(own, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    spread = large.withColumn("peer", F.explode(F.sequence(F.lit(0), last))).select(
        "block", F.least("side", "peer").alias("i"), F.greatest("side", "peer").alias("j"), "side", "norm", "rep", "open", "comp", "main"
    )
    return spread.groupBy("block", "i", "j").applyInPandas(
        lambda pdf: forest_of_chunk(pdf, threshold), "a string, b string"
    )


def merge_map(
    nodes: DataFrame,
    threshold: float = fixed.MERGE_THRESHOLD,
    plain: bool = False,
) -> DataFrame:
    """(id, keep): nodes that merge into an earlier node.

    ``keep`` is the first node of its component, however large that is.
    """
    labelled = nodes.where(F.col("label") != "")
    forms = cut(label_forms(labelled, plain))
    near, placed = _ties(forms, threshold)
    blocks = cut(_blocks(placed))
    across = _small_block_links(blocks, threshold).unionByName(_large_block_links(blocks, threshold))
    roots = _placed(forms, near.unionByName(across)).select("norm", F.col("comp").alias("root"))
    members = labelled.select("id", "ord", text.merge_norm("label", plain).alias("norm")).join(roots, "norm").drop("norm")
    keepers = members.groupBy("root").agg(F.min_by("id", "ord").alias("keep"), F.count("*").alias("n"))
    keepers = keepers.where(F.col("n") >= 2)
    return members.join(keepers, "root").where(F.col("id") != F.col("keep")).select("id", "keep", "ord")


def rewire(edges: DataFrame, merges: DataFrame, directed: bool = False) -> DataFrame:
    """Edges of merged nodes move to the kept node unless it has that edge already.

    Links inside a merged group become a self-loop of the kept node. A kept
    node's own edges win, then those of its members in node order.
    """
    m = merges.select("id", "keep", F.col("ord").alias("moved"))
    src = m.select(F.col("id").alias("source"), F.col("keep").alias("s2"), F.col("moved").alias("s_moved"))
    tgt = m.select(F.col("id").alias("target"), F.col("keep").alias("t2"), F.col("moved").alias("t_moved"))
    body = [c for c in edges.columns if c not in ("source", "target", "k1", "k2")]
    moved = (
        edges.join(src, "source", "left")
        .join(tgt, "target", "left")
        .select(
            F.coalesce("s2", "source").alias("source"),
            F.coalesce("t2", "target").alias("target"),
            F.array_compact(F.array("s_moved", "t_moved")).alias("movers"),
            *body,
        )
    )
    k1, k2 = pair_keys(directed)
    rank = F.struct(F.size("movers"), "movers", "ord") if "ord" in body else F.struct(F.size("movers"), "movers", "relation")
    return (
        moved.withColumns({"k1": k1, "k2": k2})
        .groupBy("k1", "k2")
        .agg(F.min_by(F.struct("source", "target", *body), rank).alias("e"))
        .select("k1", "k2", "e.*")
    )


def merge_duplicates(nodes: DataFrame, edges: DataFrame, directed: bool = False, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, merges) after merging near-duplicate labels."""
    merges = cut(merge_map(nodes, **options))
    kept = nodes.join(merges.select("id"), "id", "left_anti")
    return kept, rewire(edges, merges, directed), merges
