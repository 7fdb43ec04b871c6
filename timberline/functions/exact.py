"""Sums of doubles that do not depend on the order of addition.

A value becomes two whole numbers: the nearest multiple of a step, and the rest
in multiples of a step finer by ``2**bits``. Steps follow from the greatest
magnitude and the number of rows. Whole numbers add up without rounding and,
with these steps, within 64 bits, however rows are dealt to tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bits of a whole number, and exponents whose steps are still ordinary doubles.
MOST_BITS, LEAST_EXPONENT = 50, -900


@dataclass(frozen=True)
class Grid:
    bits: int
    #: For each sum, a power of two above every magnitude.
    exponents: dict[str, int]

    @classmethod
    def of(cls, df: DataFrame, terms: dict[str, Column]) -> Grid | None:
        """The grid of the given terms over ``df``, in one pass; None where a term is not finite, or tiny throughout."""
        row = df.agg(F.count("*").alias("_n"), *[F.max(F.abs(x)).alias(name) for name, x in terms.items()]).first()
        exponents = {}
        for name in terms:
            greatest = row[name] or 0.0
            exponents[name] = math.frexp(greatest)[1]
            if not math.isfinite(greatest) or exponents[name] < LEAST_EXPONENT:
                return None
        return cls(min(MOST_BITS, 62 - row["_n"].bit_length()), exponents)

    def parts(self, terms: dict[str, Column]) -> list[Column]:
        """Two whole numbers for each term: ``_<name>_hi`` and ``_<name>_lo``."""
        out = []
        for name, e in self.exponents.items():
            scaled = terms[name] * 2.0 ** (self.bits - e)
            whole = F.rint(scaled)
            out += [whole.cast("long").alias(f"_{name}_hi"), F.rint((scaled - whole) * 2.0**self.bits).cast("long").alias(f"_{name}_lo")]
        return out

    def sums(self) -> list[Column]:
        """Aggregates of the parts, in the finest steps, as whole decimals."""
        total = lambda c: F.sum(c).cast("decimal(20,0)")
        return [(total(f"_{name}_hi") * F.lit(Decimal(2**self.bits)) + total(f"_{name}_lo")).alias(name) for name in self.exponents]

    def value(self, name: str, total: Column) -> Column:
        """A sum as a double, rounded once. Sums without a grid are numbers already."""
        number = total.cast("double")
        return number * 2.0 ** (self.exponents[name] - 2 * self.bits) if name in self.exponents else number
