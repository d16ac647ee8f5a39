"""A keyed permutation of whole numbers as column arithmetic, the same in any SQL engine: each key has an order of its own, and no table of it exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
#: Fixed multipliers of the mixing function.
_M1, _M2, _MOD = 1597334677, 374761393, 1 << 31


def half_bits(n: int) -> int:
    """Half the bits of the smallest domain 4^b that holds 0 to n - 1."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def round_key(key: Column, r: int, seed: int) -> Column:
    """28 bits of the md5 of seed, key and round."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(str(r))).cast("binary")), 1, 7), 16, 10).cast("bigint")


def mixed(x: Column, k: Column) -> Column:
    """A number below 2^19 that depends on all bits of x and k; nothing exceeds 63 bits on the way."""
    y = F.shiftright(x.bitwiseXOR(k) * _M1 % _MOD, 7)
    return F.shiftright(y * _M2 % _MOD, 12)


def permuted(df: DataFrame, i: str, key: str, n: int, seed: int, name: str) -> DataFrame:
    """Adds `name`: where the permutation of this key puts i, both from 0 to 4^b - 1 for b = half_bits(n) (a Feistel network; i beyond that has no place)."""
    b = half_bits(n)
    if b > 19:
        raise ValueError("up to 2^38 numbers are permuted")
    m = (1 << b) - 1
    out = df.withColumns({f"__k{r}": round_key(F.col(key), r, seed) for r in range(ROUNDS)})
    out = out.withColumns({"__l": F.shiftright(F.col(i).cast("bigint"), b), "__r": F.col(i).cast("bigint").bitwiseAND(F.lit(m))})
    for r in range(ROUNDS):
        out = out.withColumns({"__l": F.col("__r"), "__r": F.col("__l").bitwiseXOR(mixed(F.col("__r"), F.col(f"__k{r}")).bitwiseAND(F.lit(m)))})
    return out.withColumn(name, F.shiftleft("__l", b).bitwiseOR(F.col("__r"))).drop("__l", "__r", *[f"__k{r}" for r in range(ROUNDS)])
