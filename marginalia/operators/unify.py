"""Sources that are the same wherever both say something become one.

Mentions of one base key in a document are taken in order; a mention joins the one earlier source whose details
agree with its own wherever both have one, and fills in what that source lacks. With two or more such sources it
stays apart. The fold is inherently sequential per (document, base); groups are what one base key has in one
document.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unify(mentions: DataFrame, group: Sequence[str], order: Sequence[str], details: Sequence[str]) -> DataFrame:
    """Adds `source`, 1, 2, ... within the group. details: string columns, null where unknown. Repeated equal details go through the fold once."""
    keys = [*group, *details]
    first = mentions.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    kinds = {f.name: f.dataType.simpleString() for f in first.schema.fields}
    positions = [f"_o{i}" for i in range(len(order))]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(positions, kind="stable")
        sources: list[list] = []
        number = []
        for values in rows[list(details)].astype(object).where(rows[list(details)].notna(), None).itertuples(index=False, name=None):
            fits = [k for k, s in enumerate(sources) if all(a is None or b is None or a == b for a, b in zip(s, values, strict=True))]
            if len(fits) == 1:
                sources[fits[0]] = [a if a is not None else b for a, b in zip(sources[fits[0]], values, strict=True)]
                number.append(fits[0] + 1)
            else:
                sources.append(list(values))
                number.append(len(sources))
        return rows.assign(source=number)[[*keys, "source"]]

    ranked = first.select(*keys, *[F.col(f"_first.{c}").alias(p) for c, p in zip(order, positions, strict=True)])
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", source int"
    found = ranked.groupBy(*group).applyInPandas(fold, schema)
    same = [mentions[c].eqNullSafe(found[c]) for c in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return mentions.join(found, condition).select(*[mentions[c] for c in mentions.columns], found["source"])
