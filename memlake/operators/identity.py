"""Identity on given vectors: matching against a gallery, minting, novelty, separation, threshold sweep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.columns import dot, unit
from memlake.scratch import materialize

MATCH_AT, NOVELTY_MIN, SIGNATURES_AT_MOST = 0.45, 0.10, 12
#: A gallery block that travels to the tasks holds at most so many vectors, and a part of the probes so many.
BLOCK, PROBES = 50_000, 20_000
#: Signatures of a block when all pairs are looked at.
PAIRED = 8000
#: Entities of a separation matrix at most.
SEPARATED = 2000


def clean(signatures: DataFrame) -> DataFrame:
    """Each signature once, at unit length; vectors that are null, empty, zero, hold NaN or have a wrong length drop out."""
    v = F.col("vec")
    good = (F.size(v) == F.col("dim")) & ~F.array_contains(v, F.lit(float("nan")).cast("float"))
    some = (F.array_max(v) != 0) | (F.array_min(v) != 0)
    return signatures.where(good & some).dropDuplicates(["sig_id"]).withColumn("vec", unit(v))


def best_matches(probes: DataFrame, gallery: DataFrame) -> DataFrame:
    """(probe_id, entity_id, similarity): the gallery's best signature for each probe, ties to the lesser ids.

    The gallery is cut into blocks of bounded size by hash, and the probes into parts;
    every part meets every block in one matrix product, and the best of the blocks'
    bests wins.  A signature of the gallery that has the probe's id is the probe itself
    and doesn't count.
    """
    gallery = materialize(gallery.select("entity_id", "sig_id", "vec"), "gallery")
    n = gallery.count()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-probes.count() // PROBES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shown = gallery.select(
        F.col("entity_id").alias("g_entity"), F.col("sig_id").alias("g_sig"), F.col("vec").alias("g_vec"),
        F.pmod(F.xxhash64("sig_id"), F.lit(blocks)).cast("int").alias("g_block"), every(parts).alias("g_part"),
    )
    asks = probes.select(
        "probe_id", F.col("vec").alias("vec"), F.pmod(F.xxhash64("probe_id"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block")
    )

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["g_entity", "g_sig"])
        none = pd.DataFrame({"probe_id": [], "entity_id": [], "similarity": []})
        if left.empty or right.empty:
            return none
        g = np.stack(right["g_vec"].to_numpy()).astype(np.float64)
        place = {s: i for i, s in enumerate(right["g_sig"])}
        out = []
        for i in range(0, len(left), 256):
            part = left.iloc[i : i + 256]
            sims = np.round(np.stack(part["vec"].to_numpy()).astype(np.float64) @ g.T, 9)  # so that copies tie
            own = np.array([place.get(p, -1) for p in part["probe_id"]])
            sims[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
            at, top = sims.argmax(1), sims.max(1)
            found = pd.DataFrame({"probe_id": part["probe_id"].to_numpy(), "entity_id": right["g_entity"].to_numpy()[at], "similarity": top})
            out.append(found[top > -np.inf])
        return pd.concat(out)

    found = asks.groupBy("block", "part").cogroup(shown.groupBy("g_block", "g_part")).applyInPandas(best, "probe_id string, entity_id string, similarity double")
    top = F.min_by(F.struct("entity_id", "similarity"), F.struct(-F.col("similarity"), "entity_id"))
    return found.groupBy("probe_id").agg(top.alias("m")).select("probe_id", "m.*")


def match_or_mint(faces: DataFrame, gallery: DataFrame, threshold: float = MATCH_AT, novelty: float = NOVELTY_MIN, keep: int = SIGNATURES_AT_MOST) -> DataFrame:
    """(face_id, entity_id, similarity, minted, stored) of faces in order, each seeing what those before it left.

    The fold is serial by its nature: a minted person can match the next face.  It runs
    in one task over the faces of one batch, which a stream hands over in turn.
    """

    def fold(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mat = np.zeros((0, 0))  # one row a stored vector
        owner = np.zeros(0, int)  # and its person, as a place in names
        names: list[str] = []
        place: dict[str, int] = {}
        slots: list[list[int]] = []
        n = 0

        def store(e: str, v: np.ndarray, most: int | None = None) -> None:
            nonlocal mat, owner, n
            if e not in place:
                place[e] = len(names)
                names.append(e)
                slots.append([])
            own = slots[place[e]]
            while most is not None and len(own) > most:
                owner[own.pop(0)] = -1  # more than wanted in the gallery itself
            if most is not None and len(own) == most:
                at = own.pop(0)
            else:
                at, n = n, n + 1
                if at >= len(mat):
                    more = np.zeros((max(64, 2 * len(mat)), len(v)))
                    more[: len(mat)] = mat if len(mat) else 0.0
                    mat, owner = more, np.r_[owner, np.full(len(more) - len(owner), -1)]
            mat[at], owner[at] = v, place[e]
            own.append(at)

        for e, v in right.sort_values(["created_at", "sig_id"])[["entity_id", "g_vec"]].itertuples(index=False):
            store(e, np.asarray(v, np.float64))
        out = []
        for face, vec in left.sort_values(["ts", "face_id"])[["face_id", "vec"]].itertuples(index=False):
            v = np.asarray(vec, np.float64)
            size = np.linalg.norm(v)
            v = v / size if size else v
            best, sim = None, -1.0
            if n:
                sims = mat[:n] @ v
                sims[(owner[:n] < 0) | np.isnan(sims)] = -2.0
                top = float(sims.max())
                if top > sim:
                    best, sim = names[owner[:n][sims == top].min()], top
            if best is not None and sim >= threshold:
                stored = 1.0 - sim >= novelty
                if stored:
                    store(best, v, keep)
                out.append((face, best, sim, False, stored))
            else:
                new = f"ent_{face}"
                store(new, v)
                out.append((face, new, max(0.0, sim), True, True))
        return pd.DataFrame(out, columns=["face_id", "entity_id", "similarity", "minted", "stored"])

    one = F.lit(1).alias("one")
    shown = gallery.select(F.lit(1).alias("g_one"), "entity_id", "sig_id", F.col("vec").alias("g_vec"), "created_at")
    return (
        faces.select(one, "face_id", "ts", "vec")
        .groupBy("one")
        .cogroup(shown.groupBy("g_one"))
        .applyInPandas(fold, "face_id string, entity_id string, similarity double, minted boolean, stored boolean")
    )


def similar_entities(signatures: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of entities of which any two signatures are at least ``threshold`` alike.

    All pairs of the given signatures are looked at, in blocks: for the curated gallery
    of active persons, not for the whole table (see the nearest-vector operator for that).
    """
    signatures = materialize(signatures.select("entity_id", "sig_id", "vec"), "gallery")  # read three times below
    last = F.lit(max(1, -(-signatures.count() // PAIRED)) - 1)
    rows = signatures.select("entity_id", "vec", F.pmod(F.xxhash64("sig_id"), last + 1).cast("int").alias("p"))

    def pairs(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(left["vec"].to_numpy()).astype(np.float64), np.stack(right["r_vec"].to_numpy()).astype(np.float64)
        x, y = left["entity_id"].to_numpy(), right["r_entity_id"].to_numpy()
        r, c = np.nonzero(a @ b.T >= threshold)
        s = np.einsum("ij,ij->i", a[r], b[c])
        out = pd.DataFrame({"a": np.minimum(x[r], y[c]), "b": np.maximum(x[r], y[c]), "similarity": s})
        return out[out["a"] != out["b"]].groupby(["a", "b"], as_index=False)["similarity"].max()

    # block p meets the blocks from p on from the left, and those up to p from the right
    left = rows.select(F.col("p").alias("i"), F.explode(F.sequence("p", last)).alias("j"), "entity_id", "vec")
    right = rows.select(
        F.explode(F.sequence(F.lit(0), "p")).alias("r_i"), F.col("p").alias("r_j"), F.col("entity_id").alias("r_entity_id"), F.col("vec").alias("r_vec")
    )
    found = left.groupBy("i", "j").cogroup(right.groupBy("r_i", "r_j")).applyInPandas(
        lambda k, x, y: pairs(k, x, y) if len(x) and len(y) else pd.DataFrame({"a": [], "b": [], "similarity": []}),
        "a string, b string, similarity double",
    )
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def merge_suggestions(signatures: DataFrame, entities: DataFrame, threshold: float = MATCH_AT) -> DataFrame:
    """Pairs of persons that look alike, with labels and the rounded best similarity."""
    who = entities.select(
        "entity_id", F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Person "), F.expr("right(entity_id, 6)"))).alias("label")
    )
    return (
        similar_entities(signatures, threshold)
        .join(who.select(F.col("entity_id").alias("a"), F.col("label").alias("source_label")), "a")
        .join(who.select(F.col("entity_id").alias("b"), F.col("label").alias("target_label")), "b")
        .select(F.col("a").alias("source_id"), "source_label", F.col("b").alias("target_id"), "target_label", F.bround("similarity", 2).alias("confidence"))
    )


def mean_signatures(signatures: DataFrame) -> DataFrame:
    """(entity_id, vec): the unit mean of each entity's vectors."""
    return (
        signatures.select("entity_id", F.posexplode("vec").alias("i", "x"))
        .groupBy("entity_id", "i")
        .agg(F.avg("x").alias("x"))
        .groupBy("entity_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("float")).alias("vec"))
        .withColumn("vec", unit(F.col("vec")))
    )


def separation(signatures: DataFrame) -> DataFrame:
    """(a, b, similarity) between the mean vectors of a few entities, each pair once.

    A matrix to look at while tuning: more than ``SEPARATED`` entities are refused.
    """
    means = materialize(mean_signatures(signatures), "means")
    if means.limit(SEPARATED + 1).count() > SEPARATED:
        raise ValueError(f"a separation matrix is for {SEPARATED} entities at most")
    left, right = means.select(F.col("entity_id").alias("a"), F.col("vec").alias("va")), means.select(F.col("entity_id").alias("b"), F.col("vec").alias("vb"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", dot(F.col("va"), F.col("vb")).alias("similarity"))


SWEEP = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)


def threshold_sweep(vectors: DataFrame, thresholds=SWEEP) -> DataFrame:
    """(threshold, n_entities): how many persons an online matcher would form at each threshold.

    Vectors are taken in order; each joins the nearest centroid that is near enough and
    pulls it three tenths of the way, or starts a new one.  One task a threshold, for
    tuning on a clip.
    """

    def persons(batch: np.ndarray, threshold: float) -> int:
        centres, n = np.zeros_like(batch), 0  # rows up to n are in use
        for v in batch:
            near = centres[:n] @ v
            at = int(near.argmax()) if n else n
            if at < n and near[at] >= threshold:
                pulled = 0.7 * centres[at] + 0.3 * v
                centres[at] = pulled / (np.sqrt(pulled @ pulled) or 1.0)
            else:
                centres[n], n = v, n + 1
        return n

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        batch = np.stack(pdf.sort_values("seq")["vec"].to_numpy()).astype(np.float64)
        threshold = float(pdf["threshold"].iloc[0])
        return pd.DataFrame({"threshold": [threshold], "n_entities": [persons(batch, threshold)]})

    each = vectors.select("seq", "vec", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    return each.groupBy("threshold").applyInPandas(run, "threshold double, n_entities int")


def newest(signatures: DataFrame, keep: int = SIGNATURES_AT_MOST) -> DataFrame:
    w = Window.partitionBy("entity_id", "kind").orderBy(F.desc("created_at"), F.desc("sig_id"))
    return signatures.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).drop("_k")
