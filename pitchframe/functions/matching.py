"""Similarity of two texts by their matching blocks, as a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts may be so long that a block's length has this many bits.
BITS = 20
# Fixed values of the standard matcher: from this length on, characters above this share of the second text start no block.
LONG_TEXT, POPULAR_SHARE = 200, 100
# A character no text is expected to hold, put in place of characters that may not start a block.
MASK = "\ue000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _popular(b: Column) -> Column:
    """Characters of a long second text that are too frequent to start a block; empty for a short one."""
    n = F.length(b)
    often = lambda c: n - F.length(F.replace(b, c)) > F.floor(n / POPULAR_SHARE) + 1
    return F.when(n < LONG_TEXT, F.lit("")).otherwise(F.array_join(F.filter(F.array_distinct(F.split(b, "")), often), ""))


def _places(a: Column, b: Column, size: Column) -> Column:
    """Places in `a` of all pieces of one size that `b` holds too, in order."""
    return F.filter(F.sequence(F.lit(1), F.length(a) - size + 1), lambda i: F.position(a.substr(i, size), b) > 0)


def _longest(a: Column, b: Column) -> Column:
    """size, i, j of the longest common piece: the first in `a`, then in `b`; size 0 if they share no character."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(BITS))])
    room = F.least(F.length(a), F.length(b))
    # A common piece has common pieces of all smaller sizes, so the size is found bit by bit.
    grown = lambda size, k: F.when((size + k <= room) & (F.size(_places(a, b, size + k)) > 0), size + k).otherwise(size)
    none = F.struct(F.lit(0).alias("size"), F.lit(1).alias("i"), F.lit(1).alias("j"))

    def placed(size: Column) -> Column:
        first = F.get(_places(a, b, size), 0)
        block = let(first, lambda i: F.struct(size.alias("size"), i.alias("i"), F.position(a.substr(i, size), b).alias("j")))
        return F.when(size == 0, none).otherwise(block)

    return let(F.aggregate(powers, F.lit(0), grown), placed)


def _run(a: Column, b: Column) -> Column:
    """How many characters two texts have in common from their start."""
    room = F.least(F.length(a), F.length(b))
    one = F.lit(1)
    step = lambda n, i: F.when((n == i - 1) & (a.substr(i, one) == b.substr(i, one)), i).otherwise(n)
    return F.when(room == 0, 0).otherwise(F.aggregate(F.sequence(one, F.greatest(room, one)), F.lit(0), step))


def _block(a: Column, b: Column, popular: Column) -> Column:
    """The block two texts are split at. Popular characters start none, but lengthen one on both sides."""
    some = lambda t: F.when(t != "", t)

    def lengthened(core: Column) -> Column:
        before = lambda t, at: F.reverse(t.substr(F.lit(1), at - 1))
        after = lambda t, at: t.substr(at + core["size"], F.length(t))
        left = F.when(core["size"] == 0, 0).otherwise(_run(before(a, core["i"]), before(b, core["j"])))
        right = _run(after(a, core["i"]), after(b, core["j"]))
        wide = lambda l, r: F.struct((core["size"] + l + r).alias("size"), (core["i"] - l).alias("i"), (core["j"] - l).alias("j"))  # noqa: E731, E741
        return let(left, lambda l: let(right, lambda r: wide(l, r)))  # noqa: E741

    masked = lambda t: F.call_function("translate", t, popular, F.repeat(F.lit(MASK), F.length(popular)))
    # The masks of both sides must differ, so that they never match.
    other = lambda t: F.replace(masked(t), F.lit(MASK), F.lit("\ue001"))
    long = let(masked(a), lambda x: let(other(b), lambda y: let(_longest(x, y), lengthened)))
    return F.when(some(popular).isNull(), _longest(a, b)).otherwise(long)


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks, over the characters of both texts (1.0 if both are empty).

    Blocks are those of Python's difflib: the longest common piece, then the longest ones left and right of it, and so
    on. `a` and `b` are plain columns; NULL gives NULL.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))

    def split(state: Column, popular: Column) -> Column:
        def at(text: Column) -> Column:
            x, y = text["a"], text["b"]

            def parts(k: Column) -> Column:
                left = pair(x.substr(F.lit(1), k["i"] - 1), y.substr(F.lit(1), k["j"] - 1))
                right = pair(x.substr(k["i"] + k["size"], F.length(x)), y.substr(k["j"] + k["size"], F.length(y)))
                both = F.filter(F.array(left, right), lambda p: (p["a"] != "") & (p["b"] != ""))
                todo = F.slice(state["todo"], F.lit(2), F.size(state["todo"]))
                more = F.when(k["size"] == 0, todo).otherwise(F.concat(both, todo))
                return F.struct(more.alias("todo"), (state["m"] + k["size"]).alias("m"))

            return let(_block(x, y, popular), parts)

        return F.when(F.size(state["todo"]) == 0, state).otherwise(let(F.get(state["todo"], 0), at))

    def matched(popular: Column) -> Column:
        start = F.struct(F.filter(F.array(pair(a, b)), lambda p: (p["a"] != "") & (p["b"] != "")).alias("todo"), F.lit(0).alias("m"))
        # Each text that is split gives two at most, and a block has a character at least.
        rounds = F.sequence(F.lit(0), 2 * F.least(F.length(a), F.length(b)))
        return F.aggregate(rounds, start, lambda s, _: split(s, popular), lambda s: s["m"])

    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * let(_popular(b), matched) / total)
