"""Collection functions on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.strings import col, let


def pop(a: Column | str) -> Column:
    return F.slice(col(a), 1, F.greatest(F.size(col(a)) - 1, F.lit(0)))


def take(a: Column | str, n: int) -> Column:
    return F.slice(col(a), 1, n)


def drop(a: Column | str, n: int) -> Column:
    return F.slice(col(a), n + 1, F.greatest(F.size(col(a)), F.lit(1)))


def remove_at(a: Column | str, i: int) -> Column:
    return F.filter(col(a), lambda _, k: k != i)


def replace_at(a: Column | str, i: int, value: Column) -> Column:
    return F.transform(col(a), lambda x, k: F.when(k == i, value).otherwise(x))


def indices_of(a: Column | str, value: Column) -> Column:
    """0-based places of a value."""
    marked = F.transform(col(a), lambda x, k: F.when(x == value, k))
    return F.filter(marked, lambda k: k.isNotNull())


def chunk(a: Column | str, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(col(a)), F.lit(1)), F.lit(n))
    return F.filter(let(col(a), lambda v: F.transform(starts, lambda i: F.slice(v, i, n))), lambda x: F.size(x) > 0)


def windows(a: Column | str, n: int, step: int = 1) -> Column:
    """All runs of n neighbours."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(col(a)) - (n - 1), F.lit(1)), F.lit(step))
    return F.filter(let(col(a), lambda v: F.transform(starts, lambda i: F.slice(v, i, n))), lambda x: F.size(x) == n)


def rotate(a: Column | str, n: int) -> Column:
    k = F.pmod(F.lit(n), F.greatest(F.size(col(a)), F.lit(1)))
    return F.concat(F.slice(col(a), k + 1, F.greatest(F.size(col(a)), F.lit(1))), F.slice(col(a), 1, k))


def cycle(a: Column | str, n: int) -> Column:
    return F.flatten(F.array_repeat(col(a), n))


def intersperse(a: Column | str, value: Column) -> Column:
    return drop(F.flatten(F.transform(col(a), lambda x: F.array(value, x))), 1)


def take_while(a: Column | str, test: Callable[[Column], Column]) -> Column:
    first = F.array_position(F.transform(col(a), lambda x: ~F.coalesce(test(x), F.lit(False))), True).cast("int")
    return F.when(first == 0, col(a)).otherwise(F.slice(col(a), 1, F.greatest(first - 1, F.lit(0))))


def drop_while(a: Column | str, test: Callable[[Column], Column]) -> Column:
    first = F.array_position(F.transform(col(a), lambda x: ~F.coalesce(test(x), F.lit(False))), True).cast("int")
    return F.when(first == 0, F.slice(col(a), 1, 0)).otherwise(F.slice(col(a), F.greatest(first, F.lit(1)), F.greatest(F.size(col(a)), F.lit(1))))


def partition(a: Column | str, test: Callable[[Column], Column]) -> Column:
    return F.struct(F.filter(col(a), test).alias("yes"), F.filter(col(a), lambda x: ~F.coalesce(test(x), F.lit(False))).alias("no"))


def product(a: Column | str, b: Column | str) -> Column:
    """Pairs of every element of a with every element of b (bounded by the two arrays of the row)."""
    return let(col(b), lambda w: F.flatten(F.transform(col(a), lambda x: F.transform(w, lambda y: F.struct(x.alias("x"), y.alias("y"))))))


def count_by(a: Column | str) -> Column:
    """Map of each distinct element to how often it stands there."""
    return F.map_from_entries(let(col(a), lambda v: F.transform(F.array_distinct(v), lambda x: F.struct(x, F.size(F.filter(v, lambda y: y == x))))))


_FOLDS = {
    "sum": (0.0, lambda acc, x: acc + x),
    "product": (1.0, lambda acc, x: acc * x),
    "min": (None, lambda acc, x: F.least(acc, x)),
    "max": (None, lambda acc, x: F.greatest(acc, x)),
}


def reduce(a: Column | str, kind: str) -> Column:
    start, step = _FOLDS[kind]
    return F.aggregate(F.transform(col(a), lambda x: x.cast("double")), F.lit(start).cast("double"), step)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def mean(a: Column | str) -> Column:
    return F.when(F.size(col(a)) > 0, reduce(a, "sum") / F.size(col(a)))


def variance(a: Column | str) -> Column:
    """Of the whole population."""
    squares = let(mean(a), lambda m: F.transform(col(a), lambda x: F.pow(x.cast("double") - m, 2)))
    return F.when(F.size(col(a)) > 0, F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(col(a)))


def median(a: Column | str) -> Column:
    s, n = F.array_sort(F.transform(col(a), lambda x: x.cast("double"))), F.size(col(a))
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


# Further shapes
def range_(start: Column | int, stop: Column | int, step: int = 1) -> Column:
    """start, start + step, ... before stop."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, stop))
    none = F.array().cast("array<bigint>")
    last = (b - (1 if step > 0 else -1)).cast("bigint")
    return F.when((last >= a) if step > 0 else (last <= a), F.sequence(a.cast("bigint"), last, F.lit(step).cast("bigint"))).otherwise(none)


def insert_at(a: Column | str, i: int, value: Column) -> Column:
    """0-based; places out of the array count as its ends."""
    i = max(0, i)
    return F.concat(F.slice(col(a), 1, i), F.array(value), drop(a, i))


def remove_all(a: Column | str, value: Column) -> Column:
    return F.filter(col(a), lambda x: ~x.eqNullSafe(value))


def find(a: Column | str, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(col(a), test), F.lit(0))


def find_index(a: Column | str, test: Callable[[Column], Column]) -> Column:
    """0-based, -1 if none."""
    return (F.array_position(F.transform(col(a), lambda x: F.coalesce(test(x), F.lit(False))), True) - 1).cast("int")


def find_last_index(a: Column | str, test: Callable[[Column], Column]) -> Column:
    back = F.array_position(F.reverse(F.transform(col(a), lambda x: F.coalesce(test(x), F.lit(False)))), True)
    return F.when(back == 0, -1).otherwise(F.size(col(a)) - back).cast("int")


def every(a: Column | str, test: Callable[[Column], Column]) -> Column:
    return F.forall(col(a), lambda x: F.coalesce(test(x), F.lit(False)))


def some(a: Column | str, test: Callable[[Column], Column]) -> Column:
    return F.exists(col(a), lambda x: F.coalesce(test(x), F.lit(False)))


def group_by(a: Column | str, key: Callable[[Column], Column]) -> Column:
    """Map of each key, in order of first sight, to its elements."""
    keys = lambda v: F.array_distinct(F.transform(v, key))
    return F.map_from_entries(let(col(a), lambda v: F.transform(keys(v), lambda k: F.struct(k, F.filter(v, lambda x: key(x).eqNullSafe(k))))))


def zip_(*arrays: Column | str) -> Column:
    """Structs of the elements at each place, as far as the shortest array goes."""
    names = [chr(97 + i) for i in range(len(arrays))]
    whole = F.arrays_zip(*(col(a).alias(n) for a, n in zip(arrays, names, strict=True)))
    least = F.least(*(F.size(col(a)) for a in arrays)) if len(arrays) > 1 else F.size(col(arrays[0]))
    return F.slice(whole, F.lit(1), least)


def unzip(pairs: Column | str, first: str, second: str) -> Column:
    return F.struct(F.transform(col(pairs), lambda p: p[first]).alias(first), F.transform(col(pairs), lambda p: p[second]).alias(second))


def difference(a: Column | str, b: Column | str) -> Column:
    return F.array_except(col(a), col(b))


def _keyed(b: Column | str, key: Callable[[Column], Column]) -> Column:
    return F.transform(col(b), key)


def unique_by(a: Column | str, key: Callable[[Column], Column]) -> Column:
    """The first element of each key."""
    return let(col(a), lambda v: let(_keyed(v, key), lambda k: F.filter(v, lambda x, i: F.array_position(k, key(x)) == i + 1)))


def difference_by(a: Column | str, b: Column | str, key: Callable[[Column], Column]) -> Column:
    return let(_keyed(b, key), lambda k: F.filter(col(a), lambda x: ~F.array_contains(k, key(x))))


def intersection_by(a: Column | str, b: Column | str, key: Callable[[Column], Column]) -> Column:
    return unique_by(let(_keyed(b, key), lambda k: F.filter(col(a), lambda x: F.array_contains(k, key(x)))), key)


def union_by(a: Column | str, b: Column | str, key: Callable[[Column], Column]) -> Column:
    return unique_by(F.concat(col(a), col(b)), key)


def flatten(a: Column | str) -> Column:
    return F.flatten(col(a))


def reverse(a: Column | str) -> Column:
    return F.reverse(col(a))


def transpose(a: Column | str) -> Column:
    """Rows and columns of an array of arrays exchanged; columns as far as the shortest row goes."""
    width = F.coalesce(F.array_min(F.transform(col(a), lambda r: F.size(r))), F.lit(0))
    places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return let(col(a), lambda v: F.transform(places(width), lambda i: F.transform(v, lambda r: F.get(r, i))))


def fill(value: Column, n: int) -> Column:
    return F.array_repeat(value, max(0, n))


def swap(a: Column | str, i: int, j: int) -> Column:
    return let(col(a), lambda v: F.transform(v, lambda x, k: F.when(k == i, F.get(v, F.lit(j))).when(k == j, F.get(v, F.lit(i))).otherwise(x)))


def move(a: Column | str, i: int, j: int) -> Column:
    """The element at i at place j of the result."""
    return let(col(a), lambda v: insert_at(remove_at(v, i), j, F.get(v, F.lit(i))))


def compact(a: Column | str) -> Column:
    return F.array_compact(col(a))


def compact_flat(a: Column | str) -> Column:
    """Elements of the arrays of an array, without nulls."""
    return F.array_compact(F.flatten(F.array_compact(col(a))))


def span(a: Column | str, test: Callable[[Column], Column]) -> Column:
    """yes: the elements before the first that fails; no: the rest."""
    return F.struct(take_while(a, test).alias("yes"), drop_while(a, test).alias("no"))


def break_list(a: Column | str, test: Callable[[Column], Column]) -> Column:
    return span(a, lambda x: ~F.coalesce(test(x), F.lit(False)))


def split_at(a: Column | str, n: int) -> Column:
    return F.struct(take(a, max(0, n)).alias("yes"), drop(a, max(0, n)).alias("no"))


def split_when(a: Column | str, test: Callable[[Column, Column], Column]) -> Column:
    """Runs of neighbours, cut where test(before, after) holds."""

    def cut(v: Column) -> Column:
        begins = F.filter(F.transform(v, lambda x, i: F.when((i == 0) | F.coalesce(test(F.get(v, i - 1), x), F.lit(False)), i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.transform(b, lambda s, k: F.slice(v, s + 1, F.coalesce(F.get(b, k + 1), F.size(v)) - s)))

    return let(col(a), cut)


def from_pairs(pairs: Column | str, key: str = "key", value: str = "value") -> Column:
    """Map of structs; the last of a key stays."""
    own = lambda p, f: p[f].cast("string")
    return F.aggregate(col(pairs), F.expr("map()").cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != own(p, key)), F.create_map(own(p, key), own(p, value))))


def to_pairs(m: Column | str) -> Column:
    return F.map_entries(col(m))


def iterate(start: Column, step: Callable[[Column], Column], n: int) -> Column:
    """start, step(start), step(step(start)), ...: n elements."""
    if n < 1:
        return F.slice(F.array(start), 1, 0)
    grow = lambda acc, _: F.array_append(acc, step(F.element_at(acc, -1)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.array(start), grow) if n > 1 else F.array(start)


def prepend_all(a: Column | str, *values: Column) -> Column:
    return F.concat(F.array(*values), col(a))


def append_all(a: Column | str, *values: Column) -> Column:
    return F.concat(col(a), F.array(*values))


def intercalate(a: Column | str, between: Column) -> Column:
    """The arrays of an array joined, with the array `between` between them."""
    return F.flatten(intersperse(a, between))


def subsequences(a: Column | str) -> Column:
    """All sub-arrays that keep the order, by binary number of the places (2 ** size of them: for short arrays)."""
    grow = lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, x)))
    return F.aggregate(col(a), F.array(F.slice(col(a), 1, 0)), grow)


def permutations(a: Column | str) -> Column:
    """All orders (size! of them: for short arrays)."""

    def grow(acc: Column, x: Column) -> Column:
        places = lambda s: F.sequence(F.lit(0), F.size(s))
        put = lambda s, i: F.concat(F.slice(s, F.lit(1), i), F.array(x), F.slice(s, i + 1, F.greatest(F.size(s), F.lit(1))))
        return F.flatten(F.transform(acc, lambda s: F.transform(places(s), lambda i: put(s, i))))

    return F.aggregate(col(a), F.array(F.slice(col(a), 1, 0)), grow)


def sort(a: Column | str, descending: bool = False) -> Column:
    return F.sort_array(col(a), not descending)


def top_n(a: Column | str, n: int) -> Column:
    return F.slice(F.sort_array(col(a), False), 1, n)


def bottom_n(a: Column | str, n: int) -> Column:
    return F.slice(F.sort_array(F.array_compact(col(a)), True), 1, n)


def shuffled(a: Column | str, seed: int | None = None) -> Column:
    return F.shuffle(col(a), seed) if seed is not None else F.shuffle(col(a))


def sample(a: Column | str, n: int, seed: int | None = None) -> Column:
    """n elements by chance, each place at most once."""
    return F.slice(shuffled(a, seed), 1, max(0, n))
