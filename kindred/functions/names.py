"""Names of repositories: owner, name, signatures and family, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a copy of a repository adds to its name, and the affixes of families of packages.
COPY_WORDS = ("backup", "clone", "copy", "fork", "legacy", "mirror", "new", "old", "orig", "original")
AFFIXES = (
    r"(^python-|^django-|^pytest-|^flask-|^pyramid-|^async-|^aio|-python$|-django$|-py$|-core$|-client$|-server$|-api$|-lib$|-library$|"
    r"-utils?$|-tools?$|-project$|-plugin$|-plugins$|-extension$|-extensions$|-app$|-apps$|-web$|-backend$|-frontend$|-common$|-base$)"
)
_WELL_FORMED = r"^[^/]+/.+$"


def normalised(repository: Column) -> Column:
    """Stripped, lower case; an error unless it is owner/name of letters, digits, dot, dash and underscore. Null stays null."""
    r = F.lower(F.trim(repository))
    return F.when(repository.isNull() | r.rlike(r"^[a-z0-9_.-]+/[a-z0-9_.-]+$"), r).otherwise(F.raise_error(F.concat(F.lit("no repository name: "), repository)))


def owner(repository: Column) -> Column:
    """What stands before the first slash, lower case; null if there is no owner or no name."""
    return F.when(repository.rlike(_WELL_FORMED), F.lower(F.substring_index(repository, "/", 1)))


def name(repository: Column) -> Column:
    """What stands behind the first slash, lower case."""
    return F.when(repository.rlike(_WELL_FORMED), F.lower(F.regexp_extract(repository, r"^[^/]+/(.+)$", 1)))


def family_name(repository: Column) -> Column:
    """The name without affixes, stripped until none is left (each pass that changes it makes it shorter), dashes for underscores."""
    n = name(repository)
    return F.replace(F.aggregate(F.sequence(F.lit(0), F.length(n)), n, lambda x, _: F.regexp_replace(x, AFFIXES, "")), F.lit("_"), F.lit("-"))


def signatures(repository: Column) -> Column:
    """struct(exact, family): words of the last part of the name; and these without trailing copy words, numbers and versions (all of them, if none is left)."""
    words = F.regexp_extract_all(F.lower(F.substring_index(repository, "/", -1)), F.lit(r"[a-z0-9]+"), F.lit(0))
    gone = lambda w: w.isin(*COPY_WORDS) | w.rlike(r"^([0-9]+|v[0-9]+)$")
    last = F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(gone(w), 0).otherwise(i + 1))), F.lit(0))
    exact = F.array_join(words, "-")
    return F.struct(exact.alias("exact"), F.when(last > 0, F.array_join(F.slice(words, 1, F.greatest(last, F.lit(1))), "-")).otherwise(exact).alias("family"))
