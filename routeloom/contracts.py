"""Records and settings, and what values they may have.

A field has a domain. The domain checks a setting on the driver and a column in a table, so there is
one statement of what is valid; records are rows of tables, and only settings are objects.
"""

from __future__ import annotations

import math
from dataclasses import MISSING, dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: white space at the ends of a text, as Python strips it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_LARGEST = 1.7976931348623157e308


@dataclass(frozen=True)
class Domain:
    """Texts that aren't blank, booleans, or numbers from ``low`` (beyond it, if ``above``) to ``high``."""

    kind: str
    low: float = 0.0
    high: float = _LARGEST
    above: bool = False

    def holds(self, value: object) -> bool:
        if self.kind == "text":
            return isinstance(value, str) and bool(value.strip(SPACES))
        if self.kind == "flag":
            return isinstance(value, bool)
        if isinstance(value, bool) or not isinstance(value, int if self.kind == "whole" else (int, float)):
            return False
        return self.low <= value <= self.high and not (self.above and value == self.low)

    def check(self, value, name: str):
        """``value`` itself, or ValueError."""
        if not self.holds(value):
            raise ValueError(f"{name} must be {self}, not {value!r}")
        return value

    def of_column(self, value: Column) -> Column:
        """Whether a column's value is in the domain; null never is."""
        if self.kind == "text":
            return F.coalesce(F.length(F.btrim(value, F.lit(SPACES))) > 0, F.lit(False))
        number = value.cast("double")
        least = number > F.lit(float(self.low)) if self.above else number >= F.lit(float(self.low))
        return F.coalesce(least & (number <= F.lit(float(self.high))) & ~F.isnan(number), F.lit(False))

    def __str__(self) -> str:
        if self.kind in ("text", "flag"):
            return {"text": "a string that isn't blank", "flag": "a boolean"}[self.kind]
        least = f"{'beyond' if self.above else 'from'} {self.low:g}"
        return f"a {'whole' if self.kind == 'whole' else 'finite'} number {least}" + (f" to {self.high:g}" if self.high < _LARGEST else "")


TEXT, FLAG = Domain("text"), Domain("flag")
SHARE, AMOUNT, POSITIVE = Domain("number", high=1.0), Domain("number"), Domain("number", above=True)
COUNT, ORDINAL = Domain("whole", low=1, high=math.inf), Domain("whole", high=math.inf)

# The kinds of requests, and the names of the records' fields.
HINTS = ("code", "translation", "summary", "math", "qa")
OBSERVED = {"call_id": TEXT, "query_id": TEXT, "group_id": TEXT, "query": TEXT, "model_id": TEXT, "task_type": TEXT, "quality_score": SHARE, "cost": AMOUNT, "latency_ms": AMOUNT}
ESTIMATED = {"model_id": TEXT, "pass_probability": SHARE, "estimated_cost": AMOUNT, "estimated_latency_ms": AMOUNT}


def _type(domain: Domain) -> T.DataType:
    return T.StringType() if domain is TEXT else T.DoubleType()


OBSERVATION = T.StructType([T.StructField(name, _type(domain), False) for name, domain in OBSERVED.items()])
ESTIMATES = T.ArrayType(T.StructType([T.StructField(name, _type(domain)) for name, domain in ESTIMATED.items()]))


def _of(domain: Domain, default=MISSING):
    return field(default=default, metadata={"domain": domain})


class _Settings:
    """Settings are valid once they exist: every field with a domain is checked against it."""

    def __post_init__(self) -> None:
        for f in fields(self):
            if "domain" in f.metadata:
                f.metadata["domain"].check(getattr(self, f.name), f.name)


# The names of settings and their defaults.
@dataclass(frozen=True)
class ModelCandidate(_Settings):
    """A model that may be chosen, if it is enabled."""

    model_id: str = _of(TEXT)
    enabled: bool = _of(FLAG, True)


@dataclass(frozen=True)
class RoutingPolicy(_Settings):
    router_probability_threshold: float = _of(SHARE, 0.8)
    cost_tolerance_abs: float = _of(AMOUNT, 0.0)


@dataclass(frozen=True)
class FeatureConfig(_Settings):
    ngram_range: tuple[int, int] = (2, 4)
    max_features: int = _of(COUNT, 3000)

    def __post_init__(self) -> None:
        super().__post_init__()
        low, high = (COUNT.check(n, "ngram_range") for n in self.ngram_range)
        if low > high:
            raise ValueError("ngram_range must not fall")
        object.__setattr__(self, "ngram_range", (low, high))


@dataclass(frozen=True)
class TrainingConfig(_Settings):
    quality_score_threshold: float = _of(SHARE, 0.8)
    C: float = _of(POSITIVE, 1.0)
    max_iter: int = _of(COUNT, 1000)
    seed: int = _of(ORDINAL, 20260906)
    min_model_samples: int = _of(COUNT, 40)


@dataclass(frozen=True)
class ModelStatistics:
    """A row of ``operators.statistics.model_statistics``."""

    model_id: str
    mean_cost: float
    mean_latency_ms: float
    observation_count: int
    mean_quality: float
    pass_rate: float


def distinct_ids(ids: list[str] | tuple[str, ...], what: str) -> tuple[str, ...]:
    if not ids or len(set(ids)) != len(ids):
        raise ValueError(f"{what} must be nonempty and unique")
    return tuple(ids)


def enabled_ids(candidates: list[ModelCandidate] | tuple[ModelCandidate, ...]) -> list[str]:
    """Sorted ids of the enabled candidates; duplicates and no enabled candidate are errors."""
    distinct_ids([c.model_id for c in candidates], "candidate model ids")
    active = sorted(c.model_id for c in candidates if c.enabled)
    if not active:
        raise ValueError("no eligible model: none of the candidates is enabled, which is no case for the fallback")
    return active
