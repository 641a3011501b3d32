"""HTML fields as native column expressions.

A page is read with regular expressions, not with a tree builder. Tags are
recognised with quoted attribute values, so ``>`` inside quotes does not end a
tag. Quantifiers over groups are possessive, which Java runs as loops: long
pages cannot overflow the stack.

What stands inside an element is found by the balance of its start and end tags, see
``nesting``. Where this differs from a tree builder:

* only tags of the same name close an element, the end of an element around it does not;
  an unclosed ``nav`` or content region runs to the end of the page;
* an unclosed heading ends where the next heading starts;
* a title that holds child tags counts as no title.
"""

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nesting import end_places, let, running_depth
from .text import clean_text, clean_words

# Rest of a tag after its name, up to and including the closing bracket.
_TO_CLOSE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_REST = _TO_CLOSE + ">"
_AFTER_NAME = r"(?=[\s/>])"

# One attribute: a name and an optional value.
_VALUE = r"""(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+"""
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+{_VALUE}"

# Stands in for whatever was invisible; still a tag, so it separates words.
_GAP = "<!---->"


def _open_tag(name: str) -> str:
    return f"(?is)<{name}{_AFTER_NAME}{_REST}"


def _until_end_tag(name: str) -> str:
    """Anything up to the end tag of that name, or to the end of the page."""
    return rf"(?:[^<]++|<(?!/{name}[\s/>]))*+"


def _raw_text_element(name: str) -> str:
    """Script-like element; a self-closed tag does not open one."""
    end = rf"(?:</{name}[^>]*+>)?+"
    return rf"{name}{_AFTER_NAME}{_TO_CLOSE}(?<!/)>{_until_end_tag(name)}{end}"


def strip_invisible(html: Column) -> Column:
    """Cut comments, scripts and style sheets out of a page.

    Run it once per page as a column of its own; every other function here
    expects its result.
    """
    comment = r"!--(?:[^-]++|-(?!->))*+(?:-->)?+"
    pattern = rf"(?is)<(?:{comment}|{_raw_text_element('script')}|{_raw_text_element('style')})"
    return F.regexp_replace(html, pattern, _GAP)


# Looked up in order, so the usual ones come first.
_USUAL = ("amp;", "quot;", "lt;", "gt;", "apos;", "nbsp;", "amp", "quot", "lt", "gt")

# Names that count without ``;`` as well, even before a letter; the longest wins.
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _entity_names() -> str:
    """Characters by entity name, and by code for 128-159, which mean Windows-1252."""
    known = {name: html5[name] for name in _USUAL} | html5
    for code in range(128, 160):
        known[str(code)] = bytes([code]).decode("cp1252", errors="ignore") or chr(code)
    # ASCII only, so that no character needs quoting.
    return json.dumps(known).replace("'", r"\u0027")


# As SQL text, because it is used for every field and would otherwise be most of the
# time it takes to set up a job. More than seven digits are no code point; an unknown
# name stays as it is; a text without ``&`` is passed through.
_DECODE = rf"""
x -> CASE WHEN contains(x, '&') THEN array_join(transform(
  regexp_extract_all(
    x, r'&#(?:[0-9]++|[xX][0-9a-fA-F]++);?|&[a-zA-Z][a-zA-Z0-9]*+;?|[^&]++|&', 0),
  t -> CASE WHEN startswith(t, '&') THEN element_at(transform(array(
         CASE WHEN lower(left(t, 3)) = '&#x'
             THEN cast(conv(nullif(regexp_extract(t, r'^&#.0*+([0-9a-fA-F]{{1,7}});?$', 1), ''), 16, 10) AS int)
           WHEN startswith(t, '&#')
             THEN cast(nullif(regexp_extract(t, r'^&#0*+([0-9]{{1,7}});?$', 1), '') AS int) END),
       c -> coalesce(
         try_element_at(
           from_json(r'{_entity_names()}', 'map<string,string>'),
           coalesce(cast(c AS string), substr(t, 2))),
         CASE WHEN c BETWEEN 1 AND {0xD7FF} OR c BETWEEN {0xE000} AND {0x10FFFF}
           THEN decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') END,
         CASE WHEN startswith(t, '&#') THEN '\ufffd'
           ELSE coalesce(
             try_element_at(
               from_json(r'{_entity_names()}', 'map<string,string>'),
               regexp_extract(t, r'^&({_OPEN_NAMES})', 1)
             ) || regexp_replace(t, r'^&(?:{_OPEN_NAMES})', ''), t) END)), 1)
       ELSE t END), '')
ELSE x END
"""


def decode_entities(text: Column) -> Column:
    """Replace character references."""
    return F.element_at(F.call_function("transform", F.array(text), F.expr(_DECODE)), 1)


def _raw_attribute(tag: Column, name: str, last: bool) -> Column:
    skip = "*" if last else "*?"
    pattern = (
        rf"(?is)^<[a-z][^\s/>]*+(?:[\s/]*+{_ATTRIBUTE}){skip}"
        rf"[\s/]*+((?<=[\s/\"']){name}(?=[\s/>=]){_VALUE})"
    )
    # At most one match; none leaves an empty array, which reads as null.
    found = F.try_element_at(F.regexp_extract_all(tag, F.lit(pattern), F.lit(1)), F.lit(1))
    value = r"""(?s)^[^=]*+(?:=++\s*+(?:"(.*)"|'(.*)'|(.*)))?+\z"""
    return F.regexp_replace(found, value, "$1$2$3")


def attribute(tag: Column, name: str, last: bool = False) -> Column:
    """Value of an attribute of one open tag, null when absent.

    Repeated attributes: the first counts, or the last one if ``last``.
    """
    return decode_entities(_raw_attribute(tag, name, last))


def html_title(html: Column) -> Column:
    """Text of the first title, untrimmed; null if absent, empty or not plain text."""
    text = r"(?:[^<]++|<(?![a-zA-Z/!?]))"
    opening = f"<title{_AFTER_NAME}{_REST}"
    # The first title up to the tag after its text, then that text if the tag ends the title.
    first = F.regexp_extract(
        html, rf"(?is){opening}{text}*+(?:</title{_AFTER_NAME}|<[a-zA-Z/!?])?+", 0
    )
    plain = F.regexp_extract_all(
        first, F.lit(rf"(?is)^{opening}({text}++)(?:</title)?+\z"), F.lit(1)
    )
    return decode_entities(F.try_element_at(plain, F.lit(1)))


def meta_tags(html: Column) -> Column:
    """All ``meta`` open tags of a page."""
    return F.regexp_extract_all(html, F.lit(_open_tag("meta")), F.lit(0))


def html_meta(tags: Column, name: str) -> Column:
    """``content`` of the first of the ``meta`` tags with that name, null if it has none."""
    named = F.filter(tags, lambda t: _raw_attribute(t, "name", last=True) == name)
    return attribute(F.try_element_at(named, F.lit(1)), "content", last=True)


def html_published_date(html: Column) -> Column:
    """``datetime`` of the first ``time`` tag; later tags are not tried."""
    return attribute(F.regexp_extract(html, _open_tag("time"), 0), "datetime", last=True)


def node_text(inner: Column) -> Column:
    """Visible text of inner HTML. Every tag separates words."""
    return decode_entities(F.regexp_replace(inner, rf"(?s)<[a-zA-Z/!?]{_REST}", " "))


def _pieces(names: str) -> str:
    """A tag of one of the names and what follows it, up to the next such tag."""
    tag = rf"/?(?:{names}){_AFTER_NAME}"
    return rf"(?is)<{tag}{_REST}(?:[^<]++|<(?!{tag}))*+"


def _is_end(tag: Column) -> Column:
    return F.startswith(tag, F.lit("</"))


def _delta(tag: Column) -> Column:
    return F.when(_is_end(tag), F.lit(-1)).otherwise(F.lit(1))


def html_headings(html: Column) -> Column:
    """Cleaned h1 texts, then h2, then h3; null if none survives cleaning.

    A heading inside another counts for itself and as text of the outer one.
    """
    # One scan for all levels; h4 to h6 only end an unclosed heading before them.
    found = F.regexp_extract_all(html, F.lit(_pieces("h[1-6]")), F.lit(0))

    def level_of(piece: Column) -> Column:
        return F.when(_is_end(piece), F.substring(piece, 4, 1)).otherwise(F.substring(piece, 3, 1))

    def of_level(events: Column, level: int) -> Column:
        """(place, end) of the headings of a level, in page order."""
        return F.array_sort(end_places(F.filter(events, lambda e: e["level"] == str(level))))

    def texts(pieces: Column, headings: Column, starts: Column, ranks: Column) -> Column:
        def inner(e: Column) -> Column:
            # Whole up to its end tag; without one up to the next start tag of any heading.
            next_start = F.coalesce(F.get(starts, F.get(ranks, e["place"])), F.size(pieces))
            stop = F.coalesce(e["end"], next_start)
            whole = F.array_join(F.slice(pieces, e["place"] + 1, stop - e["place"]), _GAP)
            return clean_words(node_text(whole))

        return F.transform(headings, inner)

    def all_texts(pieces: Column) -> Column:
        events = F.transform(pieces, lambda p, i: F.struct(
            i.alias("place"), _delta(p).alias("delta"), level_of(p).alias("level")))
        headings = let(events, lambda e: F.concat(*[of_level(e, n) for n in (1, 2, 3)]))
        starts = F.filter(
            F.transform(pieces, lambda p, i: F.when(~_is_end(p), i)), lambda i: i.isNotNull())
        # How many start tags there are up to each piece.
        ranks = running_depth(F.transform(pieces, lambda p: F.when(_is_end(p), F.lit(0)).otherwise(F.lit(1))))
        return let(starts, lambda s: let(ranks, lambda r: texts(pieces, headings, s, r)))

    cleaned = F.filter(let(found, all_texts), lambda x: x != "")
    return let(cleaned, lambda a: F.when(F.size(a) > 0, a))


def nav_links(html: Column) -> Column:
    """``href`` of every anchor inside ``nav``, in page order, repeats kept."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:/?nav|a){_AFTER_NAME}{_REST}"), F.lit(0))

    def is_anchor(tag: Column) -> Column:
        return F.lower(F.substring(tag, 2, 1)) == "a"

    def inside(tags: Column) -> Column:
        depths = running_depth(F.transform(tags, lambda t: F.when(is_anchor(t), F.lit(0)).otherwise(_delta(t))))
        return let(depths, lambda d: F.filter(tags, lambda t, i: is_anchor(t) & (F.get(d, i) > 0)))

    hrefs = F.transform(let(found, inside), lambda t: attribute(t, "href"))
    return F.filter(hrefs, lambda h: h.isNotNull())


def html_div_content(html: Column) -> Column:
    """Cleaned text of the first ``div`` that has the class ``content``; null without one or if it cleans to nothing.

    The region runs to the end tag that balances its start tag.
    """
    found = F.regexp_extract_all(html, F.lit(_pieces("div")), F.lit(0))

    def is_content(piece: Column) -> Column:
        # Most tags are passed without a look at their attributes.
        classes = F.when(~_is_end(piece) & F.contains(piece, F.lit("content")), attribute(piece, "class", last=True))
        return F.coalesce(F.array_contains(F.split(classes, r"[\t\n\f\r ]+"), "content"), F.lit(False))

    def region(pieces: Column, first: Column) -> Column:
        inside = F.slice(pieces, first, F.size(pieces))
        # Balance from the start tag on: its end tag is the first event after which it is zero.
        closed = F.array_position(running_depth(F.transform(inside, _delta)), 0).cast("int")
        kept = F.when(closed > 0, closed - 1).otherwise(F.size(pieces))
        return let(inside, lambda p: F.array_join(F.slice(p, 1, kept), _GAP))

    def text(pieces: Column) -> Column:
        first = F.array_position(F.transform(pieces, is_content), True).cast("int")
        return let(first, lambda i: F.when(i > 0, clean_text(node_text(region(pieces, i)))))

    return let(found, text)
