"""Scalar functions over columns: vectors as arrays, sparse vectors as maps, demographics, links, text and hashing."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- dense vectors: array<double> -------------------------------------------------------------------------------------


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def zipped(a: Column, b: Column, op) -> Column:
    return F.zip_with(a, b, op)


def dot(a: Column, b: Column) -> Column:
    return total(zipped(a, b, operator.mul))


def weighted_dot(a: Column, b: Column, w: Column) -> Column:
    return dot(zipped(a, b, operator.mul), w)


def subtract(a: Column, b: Column) -> Column:
    return zipped(a, b, operator.sub)


def multiply(a: Column, b: Column) -> Column:
    return zipped(a, b, operator.mul)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def norm1(a: Column) -> Column:
    return total(F.transform(a, F.abs))


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, norm: Column) -> Column:
    """a over its norm; a zero vector stays."""
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def cosine(a: Column, b: Column, w: Column | None = None) -> Column:
    """0 where a side is zero. w: weights of the dimensions."""
    d = (lambda x, y: weighted_dot(x, y, w)) if w is not None else dot
    return F.coalesce(F.try_divide(d(a, b), F.sqrt(d(a, a) * d(b, b))), F.lit(0.0))


def features_joined(*arrays: Column) -> Column:
    return F.concat(*arrays)


# --- sparse vectors: map<key, double> ----------------------------------------------------------------------------------


def map_total(m: Column) -> Column:
    return total(F.map_values(m))


def map_sum(a: Column, b: Column) -> Column:
    """Outer: keys of either side."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def map_dot(a: Column, b: Column) -> Column:
    """Inner: keys of both sides."""
    return map_total(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x * y, F.lit(0.0))))


def map_weighted_dot(a: Column, b: Column, w: Column) -> Column:
    """A key without a weight weighs 1."""
    return map_total(F.transform_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x * y, F.lit(0.0))), lambda k, v: v * F.coalesce(F.try_element_at(w, k), F.lit(1.0))))


def map_scale(a: Column, by: Column | float) -> Column:
    return F.transform_values(a, lambda k, v: v * by)


def map_boolean(a: Column) -> Column:
    return F.transform_values(a, lambda k, v: F.when(v != 0, 1.0).otherwise(0.0))


def map_norm2(a: Column) -> Column:
    return F.sqrt(map_dot(a, a))


def map_cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(map_dot(a, b), map_norm2(a) * map_norm2(b)), F.lit(0.0))


# --- model scalars ------------------------------------------------------------------------------------------------------


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_slope(x: Column) -> Column:
    return logistic(x) * (1 - logistic(x))


def log_sum_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def neighbour_distance(a: Column, b: Column) -> Column:
    """sqrt(1 + squared distance), so no distance is below 1."""
    d = subtract(a, b)
    return F.sqrt(1 + dot(d, d))


def connection(s: Column, t: Column, spectral: bool = False, item: Column | None = None) -> Column:
    """The predicted tie of two trait vectors: their product, or for spectral models their squared distance; by item where weighted."""
    if spectral:
        d = subtract(s, t)
        return weighted_dot(d, d, item) if item is not None else dot(d, d)
    return weighted_dot(s, t, item) if item is not None else dot(s, t)


# --- people -------------------------------------------------------------------------------------------------------------

#: The year that ages are counted from.
YEAR = 2012


def birth_year(birthday: Column) -> Column:
    """From MM/DD/YYYY; any other length has none (0)."""
    return F.when(F.length(birthday) == 10, F.right(birthday, F.lit(4)).try_cast("int")).otherwise(0)


def age_bucket(year: Column) -> Column:
    return F.when((year > 1900) & (year <= YEAR), F.floor((F.lit(YEAR) - year) / 5))


def birth_band(year: Column) -> Column:
    """The upper year of a five-year band."""
    return F.floor((year + 4) / 5) * 5


def same_band(year: Column, other: Column) -> Column:
    return birth_band(year) == birth_band(other)


def degree(kind: Column) -> Column:
    """High School 0, College 1, Graduate School 2, else none."""
    return F.when(kind == "Graduate School", 2).when(kind == "College", 1).when(kind == "High School", 0)


def gender_code(gender: Column) -> Column:
    return F.when(gender == "male", 1).otherwise(0)


def user_features(gender: Column, birthday: Column) -> Column:
    return F.array(F.when(gender == "male", 1.0).otherwise(0.0), F.when(gender == "female", 1.0).otherwise(0.0), birth_year(birthday) / float(YEAR))


def link_features(shares: Column, likes: Column, comments: Column) -> Column:
    return F.array(*[x / 1e7 for x in (shares, likes, comments)])


def yes_no(flag: Column) -> Column:
    return F.when(flag == "y", 1).when(flag == "n", 0)


# --- text ---------------------------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Split at spaces, lower-cased, without ! . , -; empty words go."""
    return F.filter(F.transform(F.split(F.lower(text), " "), lambda w: F.translate(w, "!.,-", "")), lambda w: w != "")


def cleaned(text: Column) -> Column:
    """Line ends and . ! , ? " - become spaces."""
    return F.translate(text, '\n\r.!,?"-', "        ")


def cleaned_words(text: Column) -> Column:
    return F.filter(F.split(cleaned(text), "\\s+"), lambda w: w != "")


def unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^['\"{]+|['\"}]+$", "")


def quoted_split(text: Column) -> Column:
    """Split at commas outside single quotes."""
    return F.split(text, ",(?=(?:[^']*'[^']*')*[^']*$)")


# --- deterministic draws ------------------------------------------------------------------------------------------------


def md5_bucket(seed: int, *columns: str | Column) -> Column:
    """A number below 2**32 from the first 8 hex digits of the MD5 of the values joined by a pipe; DuckDB gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def md5_bucket_sql(seed: int, *columns: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)})), 1, 8) AS BIGINT)"


def all_of(*conditions: Column) -> Column:
    return reduce(operator.and_, conditions)
