"""Fixed schemas of the data model; what a source leaves out is null."""

from pyspark.sql import types as T

LONG, INT, TEXT, REAL, FLAG, BLOB, TIME = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.BinaryType(), T.TimestampType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


POINT = _of(x=REAL, y=REAL)
BBOX = _of(x0=REAL, y0=REAL, x1=REAL, y1=REAL)
INT_BBOX = _of(x0=INT, y0=INT, x1=INT, y1=INT)
CONFIDENCE = _of(mean=REAL, min=REAL)

DOCUMENT = _of(doc_id=LONG, path=TEXT, stem=TEXT, length=LONG, modificationTime=TIME, content=BLOB)
PAGE = _of(doc_id=LONG, page_no=INT, text=TEXT, page_w=REAL)
OCR_LINE = _of(doc_id=LONG, page_no=INT, line_id=INT, text=TEXT, poly=T.ArrayType(POINT), bbox=BBOX, conf=REAL)
LAYOUT_BLOCK = _of(doc_id=LONG, page_no=INT, block_idx=INT, label=TEXT, score=REAL, bbox=INT_BBOX, crop=FLAG, crop_path=TEXT, crop_error=TEXT)
VL_BLOCK = _of(doc_id=LONG, page_no=INT, block_idx=INT, label=TEXT, content=TEXT, bbox=T.ArrayType(INT))
TABLE_CELL = _of(table_id=LONG, row_no=INT, col_no=INT, cell=TEXT)
FALLBACK = T.ArrayType(_of(backend=TEXT, reason=TEXT))
PAGE_EXTRACT = _of(
    doc_id=LONG, page=INT, engine=TEXT, text=TEXT, time=REAL, chars=INT, tables=INT, confidence=CONFIDENCE, error=TEXT, cache=TEXT,
    recognizer=_of(backend=TEXT, selection_mode=TEXT, fallback_from=FALLBACK), layout=_of(status=TEXT, blocks=INT, orphans=INT, error=TEXT),
)
CACHE = _of(cache_key=TEXT, text=TEXT, written_at=TIME)
JSONL_RESULT = _of(result=_of(layoutParsingResults=T.ArrayType(_of(markdown=_of(text=TEXT)))))
