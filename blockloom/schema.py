"""Row types of the data model. Reading order is data: every table carries its ordinal."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "ai": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


SPAN = _struct("doc_id:s page_no:i line_no:i span_no:i text:s x0:d y0:d x1:d y1:d size:d flags:i font:s color:i origin_x:d origin_y:d ascender:d descender:d")
LINE = _struct("doc_id:s page_no:i line_no:i text:s x0:d y0:d x1:d y1:d size:d bold:b color:i").add("spans", T.ArrayType(_struct("x0:d y0:d x1:d y1:d text:s")))
OCR_ITEM = _struct("doc_id:s page_no:i item_no:i y0:d x0:d x1:d y1:d text:s")
BLOCK = _struct(
    "doc_id:s page_no:i local_no:i block_id:i text:s x0:d y0:d x1:d y1:d size:d align:s bold:b single_line:b color:i keep_original:b "
    "is_chart:b ocr:b in_table:b in_image:b image_index:i fit_width:d fit_height:d line_leading:d"
)
REGION = _struct("doc_id:s page_no:i region_no:i kind:s x0:d y0:d x1:d y1:d level:i block_ids:ai parser:s")
STRUCT_CELL = _struct("doc_id:s page_no:i table_no:i row:i col:i block_id:i")
TRANSLATION = _struct("doc_id:s block_id:i lang:s text:s ok:b error:s")
OVERLAY = _struct("doc_id:s block_id:i version:l action:s text:s")
GLOSSARY = _struct("doc_id:s source:s target:s priority:i")
REPLY = _struct("batch_id:l block_ids:ai raw:s")
MESSAGE = _struct("conv_id:l turn:l role:s text:s")

#: Values of a block's hints where ingest doesn't set them; 0 means "unset" for the three fit fields.
BLOCK_DEFAULTS = {
    "size": 10.0, "align": "left", "bold": False, "single_line": True, "color": 0, "keep_original": False, "is_chart": False, "ocr": False,
    "in_table": False, "in_image": False, "image_index": -1, "fit_width": 0.0, "fit_height": 0.0, "line_leading": 0.0,
}


def with_defaults(blocks):
    """blocks with every column of BLOCK, in its order and types; absent ones get their default."""
    from pyspark.sql import functions as F

    have = set(blocks.columns)
    return blocks.select(*[(F.coalesce(F.col(f.name), F.lit(BLOCK_DEFAULTS.get(f.name))) if f.name in have else F.lit(BLOCK_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in BLOCK.fields])
