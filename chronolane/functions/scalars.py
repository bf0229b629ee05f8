"""Small row functions of the domain, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.timing import ladder
from .times import col


def whole_rect(left, top, right, bottom) -> Column:
    """The smallest rectangle of whole pixels around a real one."""
    return F.struct(F.floor(col(left)).alias("left"), F.floor(col(top)).alias("top"), F.ceil(col(right)).alias("right"), F.ceil(col(bottom)).alias("bottom"))


def sign(c) -> Column:
    """-1, 0 or 1 of text or number; 0 for what is no number."""
    return F.coalesce(F.signum(F.expr(f"try_cast({c} as double)")).cast("int"), F.lit(0))


def recoded(c, labels: dict[str, str], otherwise: str | None = None) -> Column:
    """A label by a fixed map."""
    m = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(m, col(c)), F.lit(otherwise))


def fair_share(odds) -> Column:
    """1 / odds, of odds above 1 only."""
    o = col(odds)
    return F.when(o > 1, 1 / o)


def artifact_domain(stated, kind) -> Column:
    """The stated domain, else by what the artifact's type contains."""
    k = F.lower(col(kind))
    return F.coalesce(col(stated), ladder((k.contains("result") | k.contains("label"), "POST_MATCH"), (k.contains("odds") | k.contains("market"), "MARKET"), otherwise="PRE_MATCH"))


def either_name(canonical, legacy) -> Column:
    """A value under a new or an old name; CONFLICT if both are there and differ."""
    a, b = col(canonical).cast("string"), col(legacy).cast("string")
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit("CONFLICT")).otherwise(F.coalesce(a, b))


def agreed(a, b, c) -> Column:
    """Of three readings: all equal, two equal, or none."""
    x, y, z = col(a), col(b), col(c)
    return ladder((x.eqNullSafe(y) & y.eqNullSafe(z), "UNANIMOUS"), ((x == y) | (y == z) | (x == z), "MAJORITY"), otherwise="DISPUTED")


def cells_map(cells, label: str = "label", value: str = "value") -> Column:
    """label -> value of an array of cells; null if a label comes twice."""
    c = col(cells)
    labels = F.transform(c, lambda x: x[label])
    return F.when(F.size(F.array_distinct(labels)) == F.size(labels), F.map_from_entries(F.transform(c, lambda x: F.struct(x[label], x[value]))))
