"""Schemas of the stored tables."""

from pyspark.sql import types as T

KINDS = ("semantic", "episodic", "procedural")
PRIORITIES = ("low", "normal", "high", "critical")
RELATIONS = ("relates_to", "contradicts", "depends_on", "refines")


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


MEMORIES = _fields(
    id=T.StringType(),
    ns=T.StringType(),
    key=T.StringType(),
    content=T.StringType(),
    kind=T.StringType(),
    tags=T.ArrayType(T.StringType()),
    version=T.IntegerType(),
    supersedes=T.StringType(),
    created_at=T.TimestampNTZType(),
    deleted_at=T.TimestampNTZType(),
    priority=T.StringType(),
    access_count=T.IntegerType(),
    last_accessed_at=T.TimestampNTZType(),
    meta=T.StringType(),
    expires_at=T.TimestampNTZType(),
)
#: The projection that every read returns.
MEMORY_COLS = MEMORIES.fieldNames()

CHUNKS = _fields(
    id=T.StringType(),
    memory_id=T.StringType(),
    seq=T.IntegerType(),
    text=T.StringType(),
    start_line=T.IntegerType(),
    end_line=T.IntegerType(),
    embedding=T.ArrayType(T.FloatType()),
)
#: What a segment of a store has besides: ref numbers its memories, in the order of ns and key; covered tells of a row
#: that a live row supersedes it; weight and created (a Julian day) are what a memory counts in a search.
STORED_MEMORIES = T.StructType([*MEMORIES.fields, *_fields(ref=T.LongType(), covered=T.BooleanType()).fields])
STORED_CHUNKS = T.StructType([*CHUNKS.fields, *_fields(ref=T.LongType(), weight=T.DoubleType(), created=T.DoubleType()).fields])
#: The index of a segment (operators/indexed.py): terms and trigrams by blocks of memories; and the chunks and tokens of each memory.
#: The entries of a posting are one value: of each the memory's place in its block, seq, tf and dl, as little-endian numbers of 16 bits, or all of 32,
#: which the length tells.
POSTINGS = _fields(
    term=T.StringType(),
    block=T.LongType(),
    n=T.LongType(),
    max_tf=T.IntegerType(),
    min_dl=T.IntegerType(),
    max_weight=T.DoubleType(),
    max_created=T.DoubleType(),
    entries=T.BinaryType(),
)
GRAMS = _fields(gram=T.IntegerType(), block=T.LongType(), refs=T.ArrayType(T.IntegerType()))
LENGTHS = _fields(ref=T.LongType(), memory_id=T.StringType(), chunks=T.LongType(), tokens=T.LongType())
LINKS = _fields(from_id=T.StringType(), to_id=T.StringType(), rel=T.StringType(), created_at=T.TimestampNTZType())
PUTS = _fields(
    seq=T.LongType(),
    ns=T.StringType(),
    key=T.StringType(),
    content=T.StringType(),
    kind=T.StringType(),
    tags=T.ArrayType(T.StringType()),
    priority=T.StringType(),
    meta=T.StringType(),
    ttl=T.StringType(),
)
#: Links and unlinks in the order of a log.
LINK_LOG = _fields(op_seq=T.LongType(), op=T.StringType(), id=T.StringType(), ts=T.TimestampNTZType(), to_id=T.StringType(), rel=T.StringType())
#: Changes to rows that stay: op is soft_delete, hard_delete, access, cover or uncover. A row is named by its segment and id; ns and key
#: tell other writers what was touched, and version a put what it goes on from.
CHANGES = _fields(
    op_seq=T.LongType(), op=T.StringType(), batch=T.StringType(), id=T.StringType(), ns=T.StringType(), key=T.StringType(), version=T.IntegerType(), ts=T.TimestampNTZType()
)
#: What changes come to, for each row that has any.
STATE = _fields(batch=T.StringType(), id=T.StringType(), soft=T.TimestampNTZType(), hard=T.BooleanType(), covers=T.BooleanType(), n=T.LongType(), last=T.TimestampNTZType())
