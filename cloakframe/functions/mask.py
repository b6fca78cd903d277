"""Masking found values and redacting text, as SQL expressions."""

from __future__ import annotations

from cloakframe.functions.detect import found
from cloakframe.functions.sql import let, lit, running
from cloakframe.rules import DEFAULT_RULES, Mask, Rules


# Texts are cut into windows of this many characters, in which places are found quickly.
_WINDOW = 256
# Up to so many characters times hits, a text is copied for each hit; the work of a text then has a fixed bound.
_LITTLE = 1 << 16
_HIT = "STRUCT<st:INT,en:INT,mk:STRING,loss:INT,reach:INT>"


def apply_mask(x: str, mask: Mask) -> str:
    """Masked form of a value under one mask rule."""
    if mask.template:
        start = f"substring({x}, 1, {mask.keep_start})"
        pieces = [lit(p) for p in mask.template.split("{start}")]
        return f"concat({f', {start}, '.join(pieces)})" if len(pieces) > 1 else pieces[0]
    if mask.fixed_length:
        return lit(mask.char * mask.fixed_length)
    char, kept = lit(mask.char), mask.keep_start + mask.keep_end
    stars = f"repeat({char}, char_length({x}))"
    if not kept:
        return stars
    shown = [f"substring({x}, 1, {mask.keep_start})"] if mask.keep_start else []
    shown.append(f"repeat({char}, char_length({x}) - {kept})")
    shown += [f"right({x}, {mask.keep_end})"] if mask.keep_end else []
    return f"IF(char_length({x}) <= {kept}, {stars}, concat({', '.join(shown)}))"


def mask(x: str, pii_type: str, rules: Rules = DEFAULT_RULES) -> str:
    """Mask a value known to be of a type (unknown types: all stars)."""
    return apply_mask(x, rules.mask_of(pii_type))


def mask_by_type(x: str, kind: str, rules: Rules = DEFAULT_RULES) -> str:
    """As ``mask``, the type being an expression too."""
    whens = " ".join(f"WHEN {lit(t)} THEN {apply_mask(x, m)}" for t, m in rules.masks.items())
    return f"CASE {kind} {whens} ELSE {apply_mask(x, Mask())} END" if whens else apply_mask(x, Mask())


def redact(x: str, rules: Rules = DEFAULT_RULES, overlap: str = "each", hits: str | None = None) -> str:
    """Text with every found value masked; null stays null.

    ``overlap="each"`` replaces overlapping values one by one at their original
    offsets, last start first.  ``overlap="merge"`` treats a run of overlapping
    values as one and stars it whole.  ``hits`` may name a ``found`` column.
    """
    if overlap not in ("each", "merge"):
        raise ValueError("overlap must be 'each' or 'merge'")

    body = f"IF(coalesce(size(__f), 0) <= 0, {x}, {_spliced(x, rules, overlap)})"
    return let(found(x, rules) if hits is None else hits, "__f", body)


def _spliced(x: str, rules: Rules, overlap: str) -> str:
    """The text with its hits (``__f``, last start first) replaced, in time linear in both.

    A little text is copied for each of a few hits. Else, where no two hits share a character, gaps and masks alternate. Else hits that can't touch
    each other's text are apart.  ``reach`` is how far what stands
    before a hit can reach: to the farthest end so far, and further by what masks have
    shortened, since an earlier value that overlaps later ones is cut out at its original
    offsets.  A cluster is a run of hits that start before that; clusters are spliced one
    by one, each with the text up to the next, and joined once.
    """
    whens = " ".join(
        f"WHEN {i} THEN {apply_mask('__s.value', rules.mask_of(d.name))}" for i, d in enumerate(rules.detections)
    )
    masked = f"CASE __s.ord {whens} ELSE {apply_mask('__s.value', Mask())} END"
    end = "(char_length(__s.value) - __s.back)"
    one = f"transform(__f, __s -> concat(substring({x}, 1, -__s.back), {masked}, substring({x}, {end} + 1)))[0]"
    loss = "greatest(0, char_length(__s.value) - char_length(__s.mk))" if overlap == "each" else "0"
    plain = f"transform(__f, __s -> struct(__s.back AS back, __s.value AS value, {masked} AS mk))"
    placed = f"reverse(transform({plain}, __s -> struct(-__s.back AS st, {end} AS en, __s.mk AS mk, {loss} AS loss)))"
    further = "greatest({0}, {1}.en) + {1}.loss"
    reached = running(
        "__p", "-1", lambda at, c: f"aggregate({c}, {at}, (__n, __v) -> {further.format('__n', '__v')})", further.format,
        lambda at, s: f"struct({s}.st AS st, {s}.en AS en, {s}.mk AS mk, {s}.loss AS loss, {at} AS reach)", _HIT,
    )
    starts = "filter(sequence(0, size(__h) - 1), __i -> __h[__i].st >= __h[__i].reach)"
    clusters = f"""zip_with(__b, slice(concat(__b, array(size(__h))), 2, size(__b)), (__i, __j) -> struct(
        slice(__h, __i + 1, __j - __i) AS c, IF(__j < size(__h), __h[__j].st, char_length({x})) AS up))"""
    last = "__r.c[size(__r.c) - 1]"
    if overlap == "each":
        # back to front: what follows a value is the text up to ``at`` and the rebuilt tail or, where the value
        # reaches past ``at``, the tail without its first characters
        after = f"""IF(__s.en <= __t.at, concat(substring(__l, __s.en - __r.c[0].st + 1, __t.at - __s.en), __t.tail),
            substring(__t.tail, __s.en - __t.at + 1))"""
        fold = f"""aggregate(reverse(__r.c), struct(__m AS at, '' AS tail),
            (__t, __s) -> struct(__s.st AS at, concat(__s.mk, {after}) AS tail), __t -> __t.tail)"""
        fold = let(_between("__r.c[0].st", "__m"), "__l", fold)
    else:
        fold = apply_mask(_between("__r.c[0].st", "__m"), Mask())
    upto = f"least(__r.up, {further.format(last + '.reach', last)})"
    several = let(upto, "__m", f"concat({fold}, {_between('__m', '__r.up')})")
    part = f"IF(size(__r.c) = 1, concat(__r.c[0].mk, {_between('__r.c[0].en', '__r.up')}), {several})"
    joined = f"concat({_between('0', '__h[0].st')}, array_join(transform({clusters}, __r -> {part}), ''))"
    windows = f"regexp_extract_all({x}, {lit(f'(?s).{{1,{_WINDOW}}}')}, 0)"
    # most texts have no two hits that share a character: their masks stand between the gaps
    rest = "slice(__p, 2, size(__p) - 1)"
    sharing = f"coalesce(exists(zip_with(__p, {rest}, (__a, __s) -> __s.st < __a.en), __y -> __y), false)"
    nexts = f"concat(transform({rest}, __s -> __s.st), array(char_length({x})))"
    gaps = f"zip_with(__p, {nexts}, (__a, __y) -> concat(__a.mk, {_between('__a.en', '__y')}))"
    apart = f"concat({_between('0', '__p[0].st')}, array_join({gaps}, ''))"
    clustered = let(reached, "__h", let(starts, "__b", joined))
    many = let(placed, "__p", let(windows, "__w", f"IF({sharing}, {clustered}, {apart})"))
    if overlap == "each":  # little text and few hits: one replacement after the other
        start = "-__s.back"
        fold = f"aggregate(__f, {x}, (__t, __s) -> concat(substring(__t, 1, {start}), {masked}, substring(__t, {end} + 1)))"
        many = f"IF(size(__f) * CAST(char_length({x}) AS BIGINT) <= {_LITTLE}, {fold}, {many})"
    return f"IF(size(__f) = 1, {one}, {many})"


def _between(start: str, end: str) -> str:
    """The characters from one offset up to another, out of the windows ``__w``."""
    first, last = f"({start}) DIV {_WINDOW}", f"({end} - 1) DIV {_WINDOW}"
    inner = f"slice(__w, CAST({first} AS INT) + 2, CAST({last} - {first} AS INT) - 1)"
    return f"""CASE WHEN {end} <= {start} THEN ''
        WHEN {first} = {last} THEN substring(__w[CAST({first} AS INT)], ({start}) % {_WINDOW} + 1, {end} - ({start}))
        ELSE concat(substring(__w[CAST({first} AS INT)], ({start}) % {_WINDOW} + 1), array_join({inner}, ''),
            substring(__w[CAST({last} AS INT)], 1, ({end} - 1) % {_WINDOW} + 1)) END"""
