"""The parse job: one narrow, Arrow-batched pass that turns HTML into columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sitequarry
from sitequarry.operators.html_reader import PageReader

# The reader travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sitequarry)

ROWS_PER_OUTPUT_BATCH = 64

RUN = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("style", T.IntegerType()),
        T.StructField("target", T.StringType()),
        T.StructField("cell", T.IntegerType()),
    ]
)
BLOCK = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("in_main", T.BooleanType()),
        T.StructField("grp", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("link_words", T.IntegerType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("depth", T.IntegerType()),
        T.StructField("number", T.LongType()),
        T.StructField("quotes", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("header", T.BooleanType()),
    ]
)
PARSED_FIELDS = [
    T.StructField("has_refresh", T.BooleanType()),
    T.StructField("og_title", T.StringType()),
    T.StructField("h1_text", T.StringType()),
    T.StructField("title_tag", T.StringType()),
    T.StructField("meta_desc", T.StringType()),
    T.StructField("og_desc", T.StringType()),
    T.StructField("body_chars", T.IntegerType()),
    T.StructField("hrefs", T.ArrayType(T.StringType())),
    T.StructField("blocks", T.ArrayType(BLOCK)),
    T.StructField("parse_error", T.StringType()),
]

_ARROW_RUN = pa.struct(
    [("text", pa.string()), ("style", pa.int32()), ("target", pa.string()), ("cell", pa.int32())]
)
_ARROW_BLOCK = pa.struct(
    [
        ("tag", pa.string()),
        ("in_main", pa.bool_()),
        ("grp", pa.int32()),
        ("n_words", pa.int32()),
        ("link_words", pa.int32()),
        ("runs", pa.list_(_ARROW_RUN)),
        ("depth", pa.int32()),
        ("number", pa.int64()),
        ("quotes", pa.int32()),
        ("language", pa.string()),
        ("header", pa.bool_()),
    ]
)
_ARROW_TYPES = {
    "has_refresh": pa.bool_(),
    "og_title": pa.string(),
    "h1_text": pa.string(),
    "title_tag": pa.string(),
    "meta_desc": pa.string(),
    "og_desc": pa.string(),
    "body_chars": pa.int32(),
    "hrefs": pa.list_(pa.string()),
    "blocks": pa.list_(_ARROW_BLOCK),
    "parse_error": pa.string(),
}


def _struct_lists(rows: list[list[tuple] | None], kind: pa.StructType) -> pa.Array:
    """Lists of tuples as one array of lists of structs, built column by column."""
    offsets, flat = [0], []
    for structs in rows:
        flat.extend(structs or ())
        offsets.append(len(flat))
    columns = list(zip(*flat)) or [()] * len(kind)
    fields = [
        _struct_lists(list(values), f.type.value_type)
        if pa.types.is_list(f.type)
        else pa.array(values, f.type)
        for values, f in zip(columns, kind)
    ]
    structs = pa.StructArray.from_arrays(fields, fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def parse_pages(
    pages: DataFrame, want_blocks: bool = True, max_html_chars: int | None = None
) -> DataFrame:
    """Replace ``html`` by the parsed fields; all other columns pass through.

    ``pages`` needs ``url`` and ``html``.  A page that is NULL or over the caller's limit
    is not read (F16), and a page that cannot be read carries ``parse_error`` (F24).
    """
    kept = [f for f in pages.schema.fields if f.name != "html"]
    names = [f.name for f in kept]
    fits = F.lit(True) if max_html_chars is None else F.length("html") <= max_html_chars
    source = pages.select(*names, F.when(fits, F.col("html")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_PER_OUTPUT_BATCH):
                batch = whole.slice(start, ROWS_PER_OUTPUT_BATCH)
                columns: dict[str, list] = {name: [] for name in _ARROW_TYPES}
                urls, texts = batch.column("url"), batch.column("html")
                for url, html in zip(urls, texts):
                    fields: dict = {}
                    if html.is_valid:
                        try:
                            fields = PageReader(url.as_py() or "", want_blocks).read(html.as_py())
                        except Exception as error:  # one bad page must not end the job
                            fields = {"parse_error": repr(error)}
                    for name, values in columns.items():
                        values.append(fields.get(name))
                arrays = [batch.column(name) for name in names]
                for name, arrow_type in _ARROW_TYPES.items():
                    values = columns[name]
                    arrays.append(
                        _struct_lists(values, _ARROW_BLOCK)
                        if name == "blocks"
                        else pa.array(values, arrow_type)
                    )
                yield pa.RecordBatch.from_arrays(arrays, names=names + list(_ARROW_TYPES))

    return source.mapInArrow(run, T.StructType(kept + PARSED_FIELDS))
