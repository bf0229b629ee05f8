"""Contracts of single records: each gives the names of what is wrong, all of them or the first, and null or an empty array for a sound record.

Arguments are columns or their names; unknown counts as not holding, except where a value is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import sha256_id
from ..functions.times import col
from .timing import failures, ladder
from .validation import HASH_FORM

#: States of availability, of features and of frozen inputs, and the form of a reason code.
NOT_AVAILABLE = ("UNAVAILABLE", "UNKNOWN", "NOT_VERIFIED", "CONFLICT")
FEATURE_STATES = ("AVAILABLE", "UNAVAILABLE", "UNKNOWN", "STALE", "CONFLICTED", "FUTURE_DATA", "BLOCKED")
FROZEN_STATES = ("FROZEN", "SUPERSEDED", "BLOCKED")
REASON_FORM = r"^[A-Z][A-Z0-9_]*\z"
HANDICAP_SIGN = "home_minus_away"


def blank(c) -> Column:
    """Null, or text of white space only."""
    return col(c).isNull() | (F.trim(col(c).cast("string")) == "")


def no_hash(c) -> Column:
    return ~F.coalesce(col(c).rlike(HASH_FORM), F.lit(False))


def as_of(availability, cutoff, kickoff) -> Column:
    """Whether availability <= cutoff < kickoff; false if one is unknown."""
    a, c, k = col(availability), col(cutoff), col(kickoff)
    return F.coalesce((a <= c) & (c < k), F.lit(False))


def training_sample(required: list[str], hashes: list[str], roles: tuple[str, ...], states: tuple[str, ...], bindings: list[str], role="role", state="state", sign="sign", availability="availability_at", cutoff="cutoff_at", kickoff="kickoff_at") -> Column:
    """All failures of a training sample: missing fields, role, state, as-of times, hashes, and what binds a handicap."""
    r, s = col(role), col(sign)
    unknown = col(availability).isNull() | col(cutoff).isNull() | col(kickoff).isNull()
    handicap = F.coalesce(r == "HANDICAP", F.lit(False))
    return failures(
        *((col(c).isNull(), f"REQUIRED_FIELD_MISSING:{c}") for c in sorted(required)),
        (~F.coalesce(r.isin(*roles), F.lit(False)), "ENGINE_ROLE_INVALID"), (~F.coalesce(col(state).isin(*states), F.lit(False)), "ELIGIBILITY_STATE_INVALID"),
        (unknown, "AS_OF_TIMESTAMP_INCOMPLETE"), (~unknown & ~as_of(availability, cutoff, kickoff), "AS_OF_TIME_PREDICATE_FAILED"),
        *((col(c).isNotNull() & no_hash(c), f"HASH_INVALID:{c}") for c in sorted(hashes)),
        (s.isNotNull() & (s != HANDICAP_SIGN), "HANDICAP_SIGN_CONVENTION_INVALID"),
        *((handicap & col(c).isNull(), f"HANDICAP_BINDING_REQUIRED:{c}") for c in sorted(bindings)),
        (handicap & ~s.eqNullSafe(F.lit(HANDICAP_SIGN)), "HANDICAP_SIGN_CONVENTION_REQUIRED"),
    )


def fact(status, payload, reason, detail, sides) -> Column:
    """The first thing wrong with a fact: AVAILABLE needs a payload, other states a reason code, CONFLICT two sides."""
    st, code = col(status), col(reason)
    other = st.isin(*NOT_AVAILABLE)
    return ladder(
        (~F.coalesce(st.isin("AVAILABLE", *NOT_AVAILABLE), F.lit(False)), "AVAILABILITY_STATUS_INVALID"), ((st == "AVAILABLE") & col(payload).isNull(), "PAYLOAD_REQUIRED"),
        (other & blank(reason), "REASON_CODE_REQUIRED"), (code.isNotNull() & ~code.rlike(REASON_FORM), "REASON_CODE_INVALID"), (col(detail).isNotNull() & code.isNull(), "REASON_CODE_REQUIRED"),
        ((st == "CONFLICT") & (F.coalesce(col(sides), F.lit(0)) < 2), "CONFLICT_EVIDENCE_REQUIRED"), ((st != "CONFLICT") & (col(sides) > 0), "CONFLICT_EVIDENCE_STATUS_MISMATCH"),
    )


def feature_record(state, value, reason, detail, source_refs, evidence_refs) -> Column:
    """The first thing wrong with a feature: a value if available, else a code and a detail; a reference in any case."""
    s = col(state)
    none = lambda c: F.coalesce(F.size(col(c)), F.lit(0)) <= 0
    return ladder(
        (~F.coalesce(s.isin(*FEATURE_STATES), F.lit(False)), "FEATURE_STATE_INVALID"), ((s == "AVAILABLE") & blank(value), "AVAILABLE_VALUE_EMPTY"),
        ((s != "AVAILABLE") & ~F.coalesce(col(reason).rlike(REASON_FORM), F.lit(False)), "FEATURE_REASON_REQUIRED"), ((s != "AVAILABLE") & blank(detail), "FEATURE_REASON_DETAIL_REQUIRED"),
        (none(source_refs) & none(evidence_refs), "FEATURE_PROVENANCE_MISSING"),
    )


def bundle(categories, expected: tuple[str, ...], body, stated) -> Column:
    """The first thing wrong with a bundle: its categories in exact order, and the hash of its body against the stated one."""
    return ladder((~col(categories).eqNullSafe(F.array(*map(F.lit, expected))), "CATEGORY_ORDER"), (no_hash(stated), "HASH_INVALID"), (sha256_id(col(body)) != col(stated), "BUNDLE_HASH_MISMATCH"), otherwise="OK")


def frozen_input(status, immutable, body, stated, official_refs, cutoff, kickoff, formal: bool = False) -> Column:
    """The first thing wrong with a frozen input: its state, the hash of its logical body, official references, times, legacy content."""
    st = col(status)
    steps = [(~F.coalesce(st.isin(*FROZEN_STATES) & col(immutable), F.lit(False)), "FROZEN_INPUT_STATE_INVALID")]
    if formal:
        steps.append((st != "FROZEN", "FROZEN_INPUT_NOT_USABLE"))
    return ladder(
        *steps, (no_hash(stated), "HASH_INVALID"), (~sha256_id(col(body)).eqNullSafe(col(stated)), "FROZEN_INPUT_HASH_MISMATCH"), (F.coalesce(F.size(col(official_refs)), F.lit(0)) <= 0, "OFFICIAL_ODDS_REFS_REQUIRED"),
        (~F.coalesce(col(cutoff) < col(kickoff), F.lit(False)), "CUTOFF_AFTER_KICKOFF"), (col(body).rlike("(?i)v3\\.3\\.3|v333|prediction_output"), "V3_ISOLATION_VIOLATION"), otherwise="PASS",
    )


def record_integrity(availability, cutoff, kickoff, provenance, provenance_hash, artifact_hash, record_ref, manifest_ref) -> Column:
    """All that is wrong with an archive record."""
    absent = blank(provenance)
    return failures(
        (col(availability).isNull(), "MISSING_SOURCE_AVAILABILITY_TIMESTAMP"), (col(availability).isNotNull() & ~as_of(availability, cutoff, kickoff), "AS_OF_TIME_PREDICATE_FAILED"),
        (absent, "MISSING_PROVENANCE"), (~absent & ~sha256_id(col(provenance)).eqNullSafe(col(provenance_hash)), "BROKEN_PROVENANCE_HASH"),
        (no_hash(artifact_hash), "BROKEN_ARTIFACT_HASH"), (blank(record_ref) | blank(manifest_ref), "EXACT_ARCHIVE_REF_MISSING"),
    )


def intake_blockers(home, away, rights, payload, stated, availability, cutoff, kickoff, order_status, provenance_status, stages) -> Column:
    """All gates that keep a record out of a dataset, by code."""
    return failures(
        (blank(home) | blank(away) | (col(home) == col(away)), "IDENTITY_CONFLICT"), (~col(rights).eqNullSafe(F.lit("COMPANY_OWNED")), "RIGHTS_BLOCKED_SOURCE"),
        (~sha256_id(col(payload)).eqNullSafe(col(stated)), "SOURCE_HASH_MISMATCH"), (~as_of(availability, cutoff, kickoff), "TEMPORAL_GATE_FAIL"),
        (~col(order_status).eqNullSafe(F.lit("ORDER_PROVEN")), "UNORDERED_REVISION"), (~col(provenance_status).eqNullSafe(F.lit("PROVEN")), "PROVENANCE_FAIL"),
        (F.array_contains(col(stages), "ACTUAL_SCORE"), "POSTMATCH_FEATURE_LEAK"),
    )


def replay_path(stored, latest, proofs, proof_hashes) -> Column:
    """STORED if the accepted artifact is there; REPLAY with every proof and sound hashes, and nothing of the latest version; else NONE."""
    all_hold = F.coalesce(F.forall(col(proofs), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    sound = F.coalesce(F.forall(col(proof_hashes), lambda x: x.isNull() | x.rlike(HASH_FORM)), F.lit(True))
    return ladder((col(stored), "STORED_ACCEPTED_ARTIFACT"), (~F.coalesce(col(latest), F.lit(False)) & all_hold & sound, "DETERMINISTIC_HISTORICAL_REPLAY"), otherwise="NONE")


def feature_rights(rows: DataFrame, allowed: DataFrame, feature: str, engine: str, available: str, cutoff: str, leaks: str) -> DataFrame:
    """rows with rights: LATE_FEATURE, FEATURE_LEAKAGE_FAIL by a pattern of names, ENGINE_FEATURE_ISOLATION_FAIL if the engine is not allowed it, or GRANTED."""
    a = allowed.select(feature, engine).distinct().withColumn("_allowed", F.lit(True))
    state = ladder((F.col(available) > F.col(cutoff), "LATE_FEATURE"), (F.col(feature).rlike(leaks), "FEATURE_LEAKAGE_FAIL"), (F.col("_allowed").isNull(), "ENGINE_FEATURE_ISOLATION_FAIL"), otherwise="GRANTED")
    return rows.join(a, [feature, engine], "left").withColumn("rights", state).drop("_allowed")


def alias_observation(alias, observed, ingested, cutoff) -> Column:
    """The first thing wrong with an observed alias."""
    return ladder((blank(alias), "ALIAS_EMPTY"), (col(observed).isNull() | col(ingested).isNull(), "TIME_MISSING"), (col(ingested) < col(observed), "INGESTED_BEFORE_OBSERVED"), (col(observed) > col(cutoff), "FUTURE_DATA"))


def screenshot_cell(status, payload, candidates) -> Column:
    """VERIFIED has a payload and no candidates, CONFLICTED two candidates or more, other states neither."""
    s, n = col(status), F.coalesce(F.size(col(candidates)), F.lit(0))
    return ladder(
        ((s == "VERIFIED") & (col(payload).isNull() | (n > 0)), "VERIFIED_SHAPE"), ((s == "CONFLICTED") & ((n < 2) | col(payload).isNotNull()), "CONFLICTED_SHAPE"),
        (~s.isin("VERIFIED", "CONFLICTED") & ((n > 0) | col(payload).isNotNull()), "OTHER_SHAPE"), (s.isNull(), "STATUS_MISSING"), otherwise="OK",
    )


def odds_observation(markets, expected: tuple[str, ...], availability) -> Column:
    """Exactly the expected markets, each with prices if its availability says so and without them otherwise."""
    m, a = col(markets), col(availability)
    keys = F.array_sort(F.map_keys(m))
    fits = lambda k: F.try_element_at(a, k).eqNullSafe(F.lit("AVAILABLE")) == F.try_element_at(m, k).isNotNull()
    return ladder((m.isNull() | ~F.coalesce(keys == F.array(*map(F.lit, sorted(expected))), F.lit(False)), "MARKET_KEYS"), (~F.forall(F.map_keys(m), fits), "PAYLOAD_STATE"), otherwise="OK")


def evidence_item(body, body_hash, source, source_hash, claim, claim_hash) -> Column:
    """All of an evidence item's three hashes that are not those of what they stand for."""
    return failures(*((~sha256_id(col(x)).eqNullSafe(col(h)), name) for x, h, name in ((body, body_hash, "BODY_HASH"), (source, source_hash, "SOURCE_HASH"), (claim, claim_hash, "CLAIM_HASH"))))
