"""Lineage rules over several tables. A row keeps its place and carries the first rule that it breaks, or OK.

Parents have one row for each id, so the joins are equi-joins that neither drop nor repeat a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timing import ladder


def parent(rows: DataFrame, parents: DataFrame, on: str, prefix: str, key: str | None = None) -> DataFrame:
    """rows with the columns of their parent under a prefix; `prefix + there` is null where there is none."""
    p = parents.select(*(F.col(c).alias(prefix + c) for c in parents.columns), F.lit(True).alias(prefix + "there"))
    return rows.join(p, F.col(on) == F.col(prefix + (key or on)), "left")


def differ(*pairs: tuple[str, str]) -> Column:
    """Whether any pair of columns is unequal; nulls equal nulls."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ~F.col(a).eqNullSafe(F.col(b))
    return out


def snapshot_evidence(rows: DataFrame, snapshots: DataFrame, gates: DataFrame) -> DataFrame:
    """rows(snapshot_id, gate_id, reference, observed_at) against snapshots(snapshot_id, taken_at) and gates(gate_id, reference)."""
    both = parent(parent(rows, snapshots, "snapshot_id", "s_"), gates, "gate_id", "g_")
    state = ladder((F.col("s_there").isNull(), "SNAPSHOT_MISSING"), (F.col("g_there").isNull(), "GATE_MISSING"), (F.col("observed_at") < F.col("s_taken_at"), "TIME_MISMATCH"), (differ(("reference", "g_reference")), "REF_MISMATCH"), otherwise="CONSISTENT")
    return both.select(*rows.columns, state.alias("lineage"))


def context_evidence(links: DataFrame, contexts: DataFrame, evidence: DataFrame) -> DataFrame:
    """links(context_id, evidence_id, used_hash, availability_at) against contexts and evidence (id, match_id, team_id, hash, status; contexts as_of_at)."""
    both = parent(parent(links, contexts, "context_id", "c_"), evidence, "evidence_id", "e_")
    c, e = (lambda x: F.col(f"c_{x}")), (lambda x: F.col(f"e_{x}"))
    state = ladder(
        (c("there").isNull() | e("there").isNull(), "CONTEXT_EVIDENCE_PARENT_MISSING"), (e("match_id") != c("match_id"), "CONTEXT_EVIDENCE_MATCH_MISMATCH"),
        (e("team_id").isNotNull() & ~e("team_id").eqNullSafe(c("team_id")), "CONTEXT_EVIDENCE_TEAM_MISMATCH"), (differ(("used_hash", "e_hash")), "CONTEXT_EVIDENCE_HASH_MISMATCH"),
        (F.col("availability_at") > c("as_of_at"), "CONTEXT_EVIDENCE_AVAILABILITY_AFTER_CONTEXT_ASOF"), ((c("status") != "AVAILABLE") | (e("status") != "AVAILABLE"), "CONTEXT_EVIDENCE_PARENT_NOT_AVAILABLE"), otherwise="OK",
    )
    return both.select(*links.columns, state.alias("lineage"))


def engine_membership(members: DataFrame, predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """members(prediction_id, run_id, output_hash): prediction and run agree on match, role, input, its hash and the output."""
    both = parent(parent(members, predictions, "prediction_id", "p_"), runs, "run_id", "r_")
    wrong = differ(*((f"p_{c}", f"r_{c}") for c in ("match_id", "role", "input_id", "input_hash")), ("output_hash", "r_output_hash"), ("output_hash", "p_output_hash"))
    state = ladder((F.col("p_there").isNull() | F.col("r_there").isNull(), "PREDICTION_ENGINE_PARENT_MISSING"), (wrong, "PREDICTION_ENGINE_MEMBERSHIP_LINEAGE_INVALID"), otherwise="OK")
    return both.select(*members.columns, state.alias("lineage"))


def frozen_prediction(frozen: DataFrame, predictions: DataFrame, inputs: DataFrame) -> DataFrame:
    """frozen(prediction_id, match_id, role, input_id, input_hash, frozen_at, cutoff_at, kickoff_at) against its prediction and that one's input."""
    both = parent(parent(frozen, predictions, "prediction_id", "p_"), inputs, "p_input_id", "i_", "input_id")
    wrong = differ(*((c, f"p_{c}") for c in ("match_id", "role", "input_id")), ("match_id", "i_match_id"), ("input_hash", "i_input_hash"), ("p_input_hash", "i_input_hash"))
    owner = (F.col("role") == F.col("i_owner_role")) | ((F.col("role") == "SHADOW") & (F.col("i_owner_role") == "PRODUCTION"))
    wrong = wrong | ~F.coalesce(owner, F.lit(False)) | F.coalesce((F.col("frozen_at") > F.col("cutoff_at")) | (F.col("cutoff_at") >= F.col("kickoff_at")), F.lit(False))
    state = ladder((F.col("p_there").isNull() | F.col("i_there").isNull(), "FROZEN_PREDICTION_PARENT_MISSING"), (wrong, "FROZEN_PREDICTION_LINEAGE_INVALID"), otherwise="OK")
    return both.select(*frozen.columns, state.alias("lineage"))


def tier_pair(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """pairs(production_id, shadow_id, kickoff_at, production_done_at, shadow_done_at): a production and a shadow prediction of one match and input, both done before kickoff."""
    both = parent(parent(pairs, predictions, "production_id", "p_", "prediction_id"), predictions, "shadow_id", "s_", "prediction_id")
    wrong = differ(*((f"p_{c}", f"s_{c}") for c in ("match_id", "input_id", "input_hash"))) | ~F.col("p_role").eqNullSafe(F.lit("PRODUCTION")) | ~F.col("s_role").eqNullSafe(F.lit("SHADOW"))
    late = (F.col("production_done_at") >= F.col("kickoff_at")) | (F.col("shadow_done_at") >= F.col("kickoff_at"))
    state = ladder((F.col("p_there").isNull() | F.col("s_there").isNull(), "TIER_A_PAIR_PARENT_MISSING"), (wrong, "TIER_A_SAME_MATCH_SAME_FROZEN_INPUT_PAIR_REQUIRED"), (late, "TIER_A_PREMATCH_COMPLETION_REQUIRED"), otherwise="OK")
    return both.select(*pairs.columns, state.alias("lineage"))


def pair_counts(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """How many pairs of a row of a and a row of b share a key, from the counts of both; no pair is made."""
    return a.groupBy(*key).agg(F.count("*").alias("_a")).join(b.groupBy(*key).agg(F.count("*").alias("_b")), key).select(*key, (F.col("_a") * F.col("_b")).alias("pairs"))


def review_scope(reviews: DataFrame, frozen: DataFrame, results: DataFrame) -> DataFrame:
    """reviews(frozen_id, result_id, match_id, reviewed_at, review_type, input_set, postmatch_refs): one match, after the result, no experiment, and the inputs of its type."""
    both = parent(parent(reviews, frozen, "frozen_id", "f_"), results, "result_id", "r_")
    wrong = differ(("f_match_id", "r_match_id"), ("f_match_id", "match_id")) | F.coalesce(F.col("reviewed_at") < F.col("r_verified_at"), F.lit(False)) | F.col("f_role").eqNullSafe(F.lit("EXPERIMENT"))
    kind, refs = F.col("review_type"), F.coalesce(F.size("postmatch_refs"), F.lit(0))
    state = ladder(
        (F.col("f_there").isNull() | F.col("r_there").isNull(), "REVIEW_SCOPE_PARENT_MISSING"), (wrong, "REVIEW_SCOPE_MATCH_ROLE_OR_TIME_INVALID"),
        ((kind == "MODEL_EVALUATION") & ((F.col("input_set") != "FROZEN_PREDICTION_RESULT_ONLY") | F.col("postmatch_refs").isNotNull()), "MODEL_EVALUATION_INPUT_SET_VIOLATION"),
        ((kind == "MATCH_EXPLANATION") & ((F.col("input_set") != "POSTMATCH_EXPLANATION_EVIDENCE") | (refs < 1)), "MATCH_EXPLANATION_EVIDENCE_SCOPE_INVALID"),
        (~F.coalesce(kind.isin("MODEL_EVALUATION", "MATCH_EXPLANATION"), F.lit(False)), "REVIEW_TYPE_UNKNOWN"), otherwise="OK",
    )
    return both.select(*reviews.columns, state.alias("lineage"))


def public_projection(rows: DataFrame, models: DataFrame, frozen: DataFrame, denied: str, texts: list[str]) -> DataFrame:
    """rows(model_id, frozen_id, match_id, published, business_at, kickoff_at, texts): production parents only, times up to kickoff, and no text that the pattern `denied` finds."""
    both = parent(parent(rows, models, "model_id", "m_"), frozen, "frozen_id", "f_")
    lost = F.col("m_there").isNull() | F.col("f_there").isNull() | differ(("match_id", "f_match_id"), ("model_id", "f_model_id"))
    speaks = F.lit(False)
    for c in texts:
        speaks = speaks | F.coalesce(F.col(c).rlike(denied), F.lit(False))
    state = ladder(
        (lost, "PUBLIC_PROJECTION_PARENT_LINEAGE_MISSING"), (~(F.col("m_role").eqNullSafe(F.lit("PRODUCTION")) & F.col("f_role").eqNullSafe(F.lit("PRODUCTION")) & F.coalesce("m_active", F.lit(False))), "PUBLIC_PROJECTION_PRODUCTION_ONLY_VIOLATION"),
        (F.col("published") & (F.col("business_at") > F.col("kickoff_at")), "PUBLIC_PROJECTION_BUSINESS_TIME_AFTER_KICKOFF"), (F.col("published") & speaks, "PUBLIC_PROJECTION_SAFE_FIELD_BOUNDARY_VIOLATION"), otherwise="OK",
    )
    return both.select(*rows.columns, state.alias("lineage"))


def tier_progress(samples: DataFrame, by: list[str], status: str, number: str, created: str) -> DataFrame:
    """Counts of eligible, rejected and blocked samples, the last eligible number and the latest time."""
    s = F.col(status)
    return samples.groupBy(*by).agg(
        F.count_if(s == "ELIGIBLE").alias("eligible"), F.count_if(s == "REJECTED").alias("rejected"), F.count_if(s == "BLOCKED").alias("blocked"),
        F.max(F.when(s == "ELIGIBLE", F.col(number))).alias("last_eligible"), F.max(created).alias("as_of"),
    )


def latest_update(rows: DataFrame, key: str, moments: list[str]) -> DataFrame:
    """The latest of several business times of each key; unknown times take no part."""
    return rows.groupBy(key).agg(F.max(F.greatest(*moments)).alias("updated_at"))


def count_by_kind(catalog: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """Objects of each declared kind, zero included; a kind that is not declared is left out."""
    declared = catalog.sparkSession.createDataFrame([(k,) for k in kinds], f"{kind} string")
    return declared.join(catalog.groupBy(kind).agg(F.count("*").alias("n")), kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))


def orphans(edges: DataFrame, nodes: DataFrame, child: str, upper: str, node: str) -> DataFrame:
    """Edges with orphan: whether no node declares their parent."""
    known = nodes.select(F.col(node).alias("_node")).distinct().withColumn("_there", F.lit(True))
    return edges.join(known, F.col(upper) == F.col("_node"), "left").select(child, upper, F.col("_there").isNull().alias("orphan"))
