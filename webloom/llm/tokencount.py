"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole. Each token's character span is joined with the spans of the document's sections by
an interval join over their sorted ends. A token that crosses a boundary is allocated by a rule: `start` gives it to
the section of its first byte, `end` to that of its last byte, `most` to the section with most of its bytes (the
first of equals), and `share` to every section by its share of the bytes. Counts of a document always add up to its
token count.

Defined results: sections are lines, each with its line end; text that ends in a line end has no empty last line; a
null or empty text has one empty section without tokens; repeated rows and null ids are counted like others; other
columns are ignored; an empty table gives an empty result. A null field counts as empty and keeps its place. A string
of a special token in a text is that token. A file whose tokens do not tile a text's bytes is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.common import slices
from webloom.llm.tokens import WholeTokenizer, byte_lengths

RULES = ("start", "end", "most", "share")


def attribute(ends: np.ndarray, lengths: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary); ends are byte offsets, sections tile the text."""
    n = len(section_ends)
    first = np.searchsorted(section_ends, ends - lengths, "right")
    last = np.searchsorted(section_ends, ends - 1, "right")
    cross = np.flatnonzero(first != last)
    if rule == "start" or not len(cross):
        return np.bincount(first, minlength=n).astype(float), len(cross)
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float), len(cross)
    whole = first == last
    out = np.bincount(first[whole], minlength=n).astype(float)
    for t in cross:
        low, high = ends[t] - lengths[t], ends[t]
        over = range(first[t], last[t] + 1)
        parts = [min(high, section_ends[s]) - max(low, section_ends[s - 1] if s else 0) for s in over]
        if rule == "most":
            out[over[int(np.argmax(parts))]] += 1
        else:
            out[list(over)] += np.array(parts) / lengths[t]
    return out, len(cross)


def _line_ends(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def count_lines(docs: DataFrame, tokenizer_path: str, rule: str = "most") -> DataFrame:
    """(doc_id, section, n_chars, n_tokens, n_crossing, doc_tokens) for every line of docs (doc_id, text).

    n_crossing, the tokens of the document that cross a line boundary, is given on every row.
    """
    return _counted(docs, ["text"], tokenizer_path, rule, lines=True)


def count_fields(docs: DataFrame, fields: list[str], tokenizer_path: str, rule: str = "most") -> DataFrame:
    """The same for fields that are encoded as one text, joined by line ends; section is the field's number."""
    return _counted(docs, fields, tokenizer_path, rule, lines=False)


def _counted(docs: DataFrame, fields: list[str], tokenizer_path: str, rule: str, lines: bool) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokenizer, sizes = WholeTokenizer(tokenizer_path), byte_lengths(tokenizer_path)
        for batch in slices(batches):
            source, section, chars, counts, crossing, total = [], [], [], [], [], []
            columns = [batch.column(f).to_pylist() for f in fields]
            for row, values in enumerate(zip(*columns)):
                text = values[0] or "" if lines else "\n".join(v or "" for v in values)
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                ids = tokenizer.ids(text)
                if lines:
                    bounds = _line_ends(data)
                else:
                    bounds = np.cumsum([len((v or "").encode("utf-8", "surrogatepass")) + 1 for v in values])
                    bounds[-1] -= 1
                lengths = sizes[ids]
                if lengths.sum() != len(data):
                    raise ValueError("the tokens of this file do not tile the bytes of a text")
                got, cross = attribute(np.cumsum(lengths), lengths, bounds, rule)
                letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[np.concatenate([[0], bounds])]
                source += [row] * len(bounds)
                section += range(len(bounds))
                chars += np.diff(letters).tolist()
                counts += got.tolist()
                crossing += [cross] * len(bounds)
                total += [len(ids)] * len(bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(section, pa.int64()), pa.array(chars, pa.int64()), pa.array(counts, pa.float64()), pa.array(crossing, pa.int64()), pa.array(total, pa.int64())],
                ["doc_id", "section", "n_chars", "n_tokens", "n_crossing", "doc_tokens"],
            )

    schema = f"doc_id {kind}, section long, n_chars long, n_tokens double, n_crossing long, doc_tokens long"
    return docs.select("doc_id", *fields).mapInArrow(run, schema)
