"""Table schemas: documents are ordered tables of pages."""

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE, BOOLEAN, TIME = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FIGURE = _of(id=STRING, alt=STRING, bbox=T.ArrayType(DOUBLE), caption=STRING, rotate=INT)
DOCUMENTS = _of(doc_id=STRING, source=STRING, title=STRING, author=STRING, language=STRING, fingerprint=STRING, opened_at=TIME)
PAGES = _of(
    doc_id=STRING, page_index=INT, label=STRING, html=STRING, starts_mid_paragraph=BOOLEAN, ends_mid_paragraph=BOOLEAN, skip=BOOLEAN, status=STRING,
    notes=STRING, draft_text=STRING, draft_source=STRING, figures=T.ArrayType(FIGURE), model=STRING, usage=T.MapType(STRING, LONG), version=INT,
    changed_by=STRING, updated_at=TIME,
)
PAGE_WORDS = _of(doc_id=STRING, page_index=INT, pos=INT, text=STRING, x0=DOUBLE, y0=DOUBLE, x1=DOUBLE, y1=DOUBLE)
ISSUES = _of(doc_id=STRING, page_index=INT, severity=STRING, code=STRING, message=STRING, location=STRING)
PAGE_EVENTS = _of(event_id=LONG, doc_id=STRING, page_index=INT, base_version=INT, html=STRING, status=STRING, skip=BOOLEAN, actor=STRING, at=TIME)
#: What a model's reply holds; numbers are read leniently.
MODEL_RESULT = _of(
    label=STRING, skip=BOOLEAN, starts_mid_paragraph=BOOLEAN, ends_mid_paragraph=BOOLEAN, html=STRING, notes=STRING,
    figures=T.ArrayType(_of(id=STRING, alt=STRING, bbox=T.ArrayType(STRING), caption=STRING, rotate=STRING)),
)

# The states of a page.
STATUSES = ("pending", "done", "needs_review", "error")
