"""One statement for two engines: Spark runs it, DuckDB checks it.

Statements name tables as <table>. What the two dialects spell differently is asked of a ``Dialect``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from packlens.plans.registry import query


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def rate(self, a: str, b: str) -> str:
        """a / b to four places, unknown where b is 0."""
        return f"bround(({a}) / nullif({b}, 0), 4)" if self.spark else f"round_even(({a}) / nullif({b}, 0), 4)"

    def round(self, x: str, places: int) -> str:
        return f"{'bround' if self.spark else 'round_even'}({x}, {places})"

    def joined(self, x: str, order: str, sep: str = ";", where: str = "true", distinct: bool = False) -> str:
        """The strings x of a group in the order of ``order``, joined."""
        if distinct:
            return f"array_join(array_sort(collect_set({x}) FILTER (WHERE {where})), '{sep}')" if self.spark else f"coalesce(string_agg(DISTINCT {x}, '{sep}' ORDER BY {x}) FILTER (WHERE {where}), '')"
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order}, {x} AS item)) FILTER (WHERE {where})), s -> s.item), '{sep}')"
        return f"coalesce(string_agg({x}, '{sep}' ORDER BY {order}) FILTER (WHERE {where}), '')"

    def quantile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})" if self.spark else f"quantile_cont({x}, {p})"

    def quantile_disc(self, x: str, p: float) -> str:
        return f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})" if self.spark else f"quantile_disc({x}, {p})"

    def pattern(self, p: str) -> str:
        p = p.replace("'", "''")
        return f"r'{p}'" if self.spark else f"'{p}'"

    def rlike(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.pattern(p)})" if self.spark else f"regexp_matches({x}, {self.pattern(p)})"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def replace(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}')" if self.spark else f"regexp_replace({x}, {self.pattern(p)}, '{by}', 'g')"

    def micros(self, ts: str) -> str:
        return f"unix_micros(cast({ts} AS timestamp))" if self.spark else f"epoch_us({ts})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def matches(self, x: str, p: str) -> str:
        """A row for every match of the pattern."""
        return f"explode(regexp_extract_all({x}, {self.pattern(p)}, 0))" if self.spark else f"unnest(regexp_extract_all({x}, {self.pattern(p)}))"

    def parts(self, x: str, at: str) -> str:
        """A row for every part between the separators; the separator holds no regular expression."""
        return f"explode(split({x}, '{at}'))" if self.spark else f"unnest(string_split({x}, '{at}'))"

    def lines(self, x: str) -> str:
        return f"explode(split({x}, chr(10)))" if self.spark else f"unnest(string_split({x}, chr(10)))"

    def days(self, a: str, b: str) -> str:
        return f"datediff({a}, {b})" if self.spark else f"date_diff('day', {b}, {a})"

    def plus_days(self, d: str, n: str) -> str:
        return f"date_add({d}, {n})" if self.spark else f"CAST({d} + to_days(CAST({n} AS INTEGER)) AS DATE)"

    def absent(self, x: str, key: str, of: str, where: str = "true") -> str:
        """Whether ``x`` is no ``key`` of a relation. Spark joins this by shuffle or checked broadcast; NOT IN always broadcasts."""
        return f"NOT EXISTS (SELECT 1 FROM {of} gone WHERE {where} AND gone.{key} = {x})" if self.spark else f"{x} NOT IN (SELECT {key} FROM {of} WHERE {where})"

    def bits(self, x: str) -> str:
        return f"bit_count({x})"

    def xor(self, a: str, b: str) -> str:
        return f"({a} ^ {b})" if self.spark else f"xor({a}, {b})"


SPARK, DUCK = Dialect(True), Dialect(False)


def statement(name: str, text: Callable[[Dialect], str], oracle: Callable[[Dialect], str] | None = None) -> None:
    """Register a query given as SQL; ``oracle`` where the checking engine needs another statement."""
    checked = re.sub(r"<(\w+)>", r"\1", (oracle or text)(DUCK))

    @query(name, checked)
    def run(spark, sf_dir):
        return spark.sql(re.sub(r"<(\w+)>", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text(SPARK)))
