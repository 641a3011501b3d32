"""Balanced tags as native array expressions.

A page becomes an array of events, one per tag of the wanted names. Opening counts +1, closing -1, and a
running depth over the events says what stands inside what; it never falls below zero, so end tags without
a start tag are ignored. Events of one depth are an opening, its end, the next opening, its end and so on:
sorted by depth and place, every start tag stands right before its end tag.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Events that one running sum passes through. Appending copies an array, so it is done in short
# blocks, whose effects on the depth are composed: twice the page costs twice the time.
BLOCK = 128

# As SQL text, because it is used several times a page and setting it up call by call takes a second.
# ``blocks``; ``effects``: a block takes depth x to greatest(floor, x + shift); ``entered``: depth before each
# block; then the depth after each event inside the blocks.
_DEPTH = f"""
d -> element_at(transform(array(
    transform(sequence(0, greatest(size(d) - 1, 0) div {BLOCK}), k -> slice(d, cast(k * {BLOCK} + 1 AS int), {BLOCK}))),
  blocks -> element_at(transform(array(
      transform(blocks, b -> aggregate(b, named_struct('floor', 0, 'shift', 0),
        (s, x) -> named_struct('floor', greatest(0, s.floor + x), 'shift', s.shift + x)))),
    effects -> element_at(transform(array(
        aggregate(effects, array(0), (all, e) -> array_append(all, greatest(e.floor, element_at(all, -1) + e.shift)))),
      entered -> flatten(transform(blocks, (b, k) -> slice(
        aggregate(b, array(get(entered, k)), (all, x) -> array_append(all, greatest(0, element_at(all, -1) + x))),
        2, {BLOCK})))), 1)), 1)), 1)
"""

# The depth of the element itself: after its start tag, before its end tag. Depth 0 holds end tags
# without a start tag only. In order of depth and place, the event after a start tag ends it if it is an end.
_ENDS = f"""
events -> element_at(transform(
  transform(array(transform(events, e -> e.delta)), {_DEPTH}),
  depths -> element_at(transform(array(array_sort(filter(
      transform(events, (e, i) -> named_struct(
        'depth', CASE WHEN e.delta > 0 THEN get(depths, i) WHEN i > 0 THEN get(depths, i - 1) ELSE 0 END,
        'place', e.place, 'open', e.delta > 0)),
      e -> e.depth > 0))),
    s -> filter(
      transform(s, (e, i) -> named_struct(
        'place', e.place,
        'end', CASE WHEN get(s, i + 1).depth = e.depth AND NOT get(s, i + 1).open THEN get(s, i + 1).place END,
        'open', e.open)),
      e -> e.open)), 1)), 1)
"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _apply(function: str, value: Column) -> Column:
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), F.lit(0))


def running_depth(deltas: Column) -> Column:
    """Depth after each event; ``deltas`` are +1, 0 or -1."""
    return _apply(_DEPTH, deltas)


def end_places(events: Column) -> Column:
    """(place, end) of every start tag, by depth and place; ``end`` is null for one that is never closed.

    ``events``: structs of ``place``, ascending, and ``delta``, +1 or -1.
    """
    return _apply(_ENDS, events)
