"""Label grammar: a label lists tags between commas, a tag is a path written with colons.

``PIANO: ELECTRIC, LO-FI`` holds the paths (PIANO, ELECTRIC) and (LO-FI); a path implies all its prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = ": "


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sanitize_name(name: Column) -> Column:
    """Lower-cased name of letters, digits, blanks, ``_`` and ``-``, with single blanks and none at the ends."""
    kept = F.regexp_replace(F.lower(strip(name)), r"[^a-z0-9 _-]", "")
    return F.trim(F.regexp_replace(kept, r" +", " "))


def stem(path: Column) -> Column:
    """File name without its last suffix; a name that only starts with a dot keeps it."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]+$", "")


def written_paths(label: Column) -> Column:
    """The label's paths as arrays, upper-cased, each once, in the order written; empty steps and tags are dropped."""
    steps = lambda tag: F.filter(F.transform(F.split(tag, ":"), strip), lambda s: s != "")
    tags = F.transform(F.split(F.upper(F.coalesce(label, F.lit(""))), ","), steps)
    return F.array_distinct(F.filter(tags, lambda p: F.size(p) > 0))


def format_path(path: Column) -> Column:
    return F.array_join(path, STEP)


def format_paths(paths: Column) -> Column:
    return F.array_join(F.transform(paths, format_path), ", ")


def canonical_label(label: Column, strict: bool = False) -> Column:
    """The label in canonical form; without any tag null, or an error if ``strict``."""
    paths = written_paths(label)
    missing = F.raise_error(F.lit("the label holds no tag")) if strict else F.lit(None)
    return F.when(F.size(paths) == 0, missing.cast("string")).otherwise(format_paths(paths))


def prefixes(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, 1, n))


def closure(paths: Column) -> Column:
    """All paths and their prefixes, each once."""
    return F.array_distinct(F.flatten(F.transform(paths, prefixes)))


def top_level(paths: Column) -> Column:
    return F.array_distinct(F.transform(paths, lambda p: F.element_at(p, 1)))


def truncated(paths: Column, depth: int) -> Column:
    return F.array_distinct(F.transform(paths, lambda p: F.slice(p, 1, depth)))


def agreement(a: Column, b: Column) -> Column:
    """Jaccard similarity of the closures of two path sets; 0 if both are empty."""
    ca, cb = closure(a), closure(b)
    union = F.size(F.array_union(ca, cb))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(ca, cb)) / union)


def asserts(paths: Column, path: Column) -> Column:
    """Whether a path or one of its descendants is among the paths."""
    return F.array_contains(closure(paths), path)


def with_tag(paths: Column, path: Column) -> Column:
    """The paths with one more, unless they already assert it; prefixes of the new path give way to it."""
    wider = F.filter(paths, lambda p: p != F.slice(path, 1, F.size(p)))
    return F.when(asserts(paths, path), paths).otherwise(F.concat(wider, F.array(path)))


def first_in(tags: Column, chosen: Column) -> Column:
    """The first tag that is among ``chosen``, or null."""
    return F.get(F.filter(tags, lambda t: F.array_contains(chosen, t)), F.lit(0))


def prompt(path: Column, template: str = "{}") -> Column:
    """A describing phrase: the path from its end, lower-cased, inside ``template``."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), F.lower(F.array_join(F.reverse(path), " ")), F.lit(after))


def page_url(url: Column) -> Column:
    """Whether a text is an http(s) address with a host and no blanks."""
    return F.coalesce(url.rlike(r"^https?://[^\s/?#]+[^\s]*$"), F.lit(False))


def glob(text: Column, pattern: str) -> Column:
    """Case-folded file-name pattern with ``*``, ``?`` and ``[...]``."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body, i = pattern[i:end], end + 1
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
        else:
            out += {"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c) or (c if c.isalnum() else "\\" + c)
    return F.lower(text).rlike(f"^(?:{out})$") if pattern == pattern.lower() else glob(text, pattern.lower())


def inside_root(path: Column) -> Column:
    """Whether a relative path stays below its root: no leading slash, no empty, ``.`` or ``..`` step, no NUL."""
    steps = F.split(path, "/")
    return F.coalesce(~path.startswith("/") & ~path.contains("\u0000") & ~path.contains("\\") & F.forall(steps, lambda s: ~s.isin("", ".", "..")), F.lit(False))
