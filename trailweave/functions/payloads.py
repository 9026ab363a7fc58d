"""JSON payload texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_json(text: Column) -> Column:
    """The text as a variant if all of it is one JSON value, otherwise NULL.

    The parser stops after a first value.  So the text is parsed as the first element
    of a list that ends with a mark: anything after the value breaks the list, adds an
    element or loses the mark.  The mark is a digest of the text, which the text does not hold.
    """
    mark = F.md5(text)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    # Read by place: a third element, or a second one that is not the mark, means that more than one value was there.
    whole = F.try_variant_get(listed, "$[1]", "string") == mark
    more = F.try_variant_get(listed, "$[2]", "variant").isNotNull()
    return F.when(F.coalesce(whole, F.lit(False)) & ~more, F.try_variant_get(listed, "$[0]", "variant"))
