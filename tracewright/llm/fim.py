"""Fill-in-middle: whole texts cut into lines, which a pipeline of Arrow kernels regroups into prefix, middle and suffix.

A unit is a line with its line feed, or what follows the last one. A row's four numbers come from the sha256 of
``salt:id``: two cuts among the units, whether the row is changed at all, and in which order. Each batch is worked on by
kernels alone: texts are split into list arrays, the lists flattened with the index of their row, each unit's ordinal
in its row compared with the two cuts, the units of a role filtered and rebuilt into lists by row, and the lists
joined to one text each. Nothing is shuffled; memory follows a slice of about 4 MiB of text, or one longer text.

Defined results: a null text is empty; an empty text, one that holds a marker and one beyond ``rate`` are plain,
their output is the text; a null id counts as an empty one; rows that repeat an id each get its draws for their own
text; an empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.llm.words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ROLES = range(3)  # prefix, middle, suffix


def units(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of all texts in a row, each with its line feed, and the index of the text that each comes from."""
    lists = pc.split_pattern(text, "\n")
    parent, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    row = parent.to_numpy()
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    ends = pc.if_else(pa.array(last), pa.scalar("", text.type), pa.scalar("\n", text.type))
    whole = pc.binary_join_element_wise(flat, ends, pa.scalar("", text.type))
    some = pc.greater(pc.binary_length(whole), 0)  # after a last line feed, and in an empty text, there is no unit
    return whole.filter(some), row[some.to_numpy(zero_copy_only=False)]


def joined(flat: pa.Array, row: np.ndarray, keep: np.ndarray, n: int) -> pa.Array:
    """The kept units of each of ``n`` texts as one text."""
    at = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=n))))
    large = pa.types.is_large_string(flat.type)
    lists = (pa.LargeListArray if large else pa.ListArray).from_arrays(pa.array(at, pa.int64() if large else pa.int32()), flat.filter(pa.array(keep)))
    return pc.binary_join(lists, pa.scalar("", flat.type))


def _rearranged(batches):
    for batch in slices(batches, "text"):
        id, text, a, b, changes, suffix_first = batch.columns
        text, n = pc.fill_null(text, ""), batch.num_rows
        flat, row = units(text)
        size = np.bincount(row, minlength=n)
        ordinal = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        cut = np.sort([a.to_numpy() % (size + 1), b.to_numpy() % (size + 1)], axis=0)
        role = (ordinal >= cut[0][row]).astype(int) + (ordinal >= cut[1][row])
        prefix, middle, suffix = (joined(flat, row, role == r, n) for r in ROLES)
        marked = pc.match_substring(text, PREFIX)
        for mark in (SUFFIX, MIDDLE):
            marked = pc.or_(marked, pc.match_substring(text, mark))
        plain = pc.or_(pc.or_(marked, pc.equal(pc.binary_length(text), 0)), pc.invert(changes))
        tell = lambda *parts: pc.binary_join_element_wise(*(pa.scalar(x, text.type) if isinstance(x, str) else x for x in parts), pa.scalar("", text.type))
        psm, spm = tell(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), tell(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
        output = pc.if_else(plain, text, pc.if_else(suffix_first, spm, psm))
        form = pc.if_else(plain, "plain", pc.if_else(suffix_first, "spm", "psm"))
        chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
        yield pa.RecordBatch.from_arrays([id, pa.array(size.astype(np.int64)), form, *chars, output], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def draw(salt: str, id: str, k: int) -> Column:
    """The k-th group of 8 hexadecimal digits, from 0, of the sha256 of ``salt:id``."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name.cast("binary"), 256), 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", salt: str = "7", rate: int = 100, suffix_first: int = 50) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    ``rate`` of a hundred rows are changed, and ``suffix_first`` of a hundred of those are spm, the others psm.
    """
    drawn = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), draw(salt, id, 0).alias("a"), draw(salt, id, 1).alias("b"), (draw(salt, id, 2) % 100 < rate).alias("changes"), (draw(salt, id, 3) % 100 < suffix_first).alias("suffix_first"))
    kind = docs.schema[id].dataType.simpleString()
    out = drawn.mapInArrow(_rearranged, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from; its pieces hold no marker, so the first one met is where a piece ends."""
    body = F.substr(output, F.lit(4))
    one = F.call_function("locate", F.when(form == "psm", SUFFIX).otherwise(PREFIX), body)
    head, rest = F.left(body, one - 1), F.substr(body, one + 3)
    two = F.call_function("locate", F.lit(MIDDLE), rest)
    tail, middle = F.left(rest, two - 1), F.substr(rest, two + 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
