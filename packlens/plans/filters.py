"""Dashboard filters: parsed from and written to query parameters, and turned into predicates over the facts."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = {"low": 1, "medium": 2, "high": 3}
STATUSES = ("PASS", "FAIL", "REVIEW")


@dataclass(frozen=True)
class ScanFilters:
    date_from: date | None = None
    date_to: date | None = None
    district: str | None = None
    category: str | None = None
    brand: str | None = None
    severity: str | None = None
    rule_id: str | None = None
    status: str | None = None

    @classmethod
    def parse(cls, params: dict[str, str]) -> ScanFilters:
        names = {f.name for f in fields(cls)}
        if unknown := set(params) - names:
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        got = {k: v for k, v in params.items() if v != ""}
        if got.get("severity", "low") not in RANKS or got.get("status", "PASS") not in STATUSES:
            raise ValueError("unknown severity or status")
        return cls(**{k: date.fromisoformat(v) if k.startswith("date") else v for k, v in got.items()})

    def params(self) -> dict[str, str]:
        return {k: v.isoformat() if isinstance(v, date) else v for k, v in asdict(self).items() if v is not None}

    def previous(self) -> ScanFilters | None:
        """The period of equal length that ends the day before; brand, rule and status don't carry over."""
        if self.date_from is None or self.date_to is None:
            return None
        span = self.date_to - self.date_from
        end = self.date_from - timedelta(days=1)
        return ScanFilters(end - span, end, self.district, self.category, severity=self.severity)

    def apply(self, facts: DataFrame, verdicts: DataFrame) -> DataFrame:
        """Scans that fit; each condition on verdicts is a semi-join of its own, so no scan fans out."""
        day = F.to_date("captured_at")
        tests: list[Column] = []
        if self.date_from:
            tests.append(day >= F.lit(self.date_from))
        if self.date_to:
            tests.append(day <= F.lit(self.date_to))
        if self.district:
            tests.append(F.col("district") == self.district)
        if self.category:
            tests.append(F.col("category") == self.category)
        if self.brand:
            tests.append(F.lower("brand").contains(self.brand.lower()))
        if self.status:
            tests.append({"REVIEW": F.col("needs_review"), "FAIL": F.col("non_compliant"), "PASS": F.col("conclusive") & ~F.col("non_compliant")}[self.status])
        for t in tests:
            facts = facts.where(t)
        if self.severity:
            rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(r)) for s, r in RANKS.items()])
            facts = facts.join(verdicts.where(F.col("failure") & (rank >= RANKS[self.severity])), "scan_id", "left_semi")
        if self.rule_id:
            facts = facts.join(verdicts.where(F.col("counts") & (F.col("rule_id") == self.rule_id)), "scan_id", "left_semi")
        return facts
