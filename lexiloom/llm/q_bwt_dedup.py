"""op4: every document without the 200-byte strings that occur elsewhere."""

from __future__ import annotations

from lexiloom.llm.bwt_dedup import remove_repeats
from lexiloom.llm.common import table


def op4_bwt_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op4_bwt_dedup": op4_bwt_dedup}
