"""What several operators share: the shared folder, written intermediate tables, and the tokenizer."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array

from pyspark.sql import DataFrame, SparkSession

#: Printable ASCII and Latin letters with marks (none is white space), and the letters among them.
SOLID = "!-~À-ɏ"
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Pieces of a text that byte-level BPE encodes alike alone and in context: the pre-tokenizer always starts a new token
#: where one space or line break stands between solid characters, and where a run of letters ends before other ASCII.
PIECE = re.compile(
    rf"[ \n]?[{LETTER}]+(?=[!-@\[-`{{-~]|[ \n][{SOLID}]|\Z)|[ \n]?.+?(?:(?<=[{SOLID}])(?=[ \n][{SOLID}])|\Z)", re.S
)
#: Byte-level BPE's printable character for each byte: itself for printable Latin-1, else the next from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone, where driver and executors are
    one machine, a folder of our own does where that is unset; a cluster without the setting is an error. A path without a
    scheme is one of the cluster's default file system."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            path = jvm.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            path = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path if re.match(r"\w+:/", path) else _hadoop(spark, path)[0].makeQualified(_hadoop(spark, path)[1]).toString()


def _hadoop(spark: SparkSession, path: str):
    """A path's file system and Hadoop's path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch: texts are long, and a worker holds a batch several times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trim() -> None:
    """Gives a worker's free memory back to the system: workers stay, idle, beside those of the next stage."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again. Survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a written() result, once nothing that is still to run reads it."""
    fs, path = _hadoop(df.sparkSession, df.written_to)
    fs.delete(path, True)


class Encoder(dict):
    """Whole texts to token ids as little-endian unsigned 32-bit bytes, by the tokenizers library.

    Each distinct piece (see PIECE) is encoded once while it stays in the cache. The cache has two generations of at most
    `room` pieces each: when the young one is full it becomes the old one, and pieces found there are young again, so
    frequent pieces stay and memory is bounded. Special-token strings in a text are ordinary text.
    """

    def __init__(self, path: str, room: int = 150_000):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.room, self.old = room, {}
        self.model = self.tokenizer.model
        self.newline = self["\n"] if isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) else None

    def __missing__(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Caches new pieces. One word is one token of the pre-tokenizer, so it goes straight to the BPE model."""
        if len(self) + len(pieces) > self.room:
            self.old = dict(self)
            self.clear()
        old, tokenize, plain = self.old.get, self.model.tokenize, self.newline is not None
        for piece in pieces:
            ids = old(piece)
            if ids is None:
                if plain and piece[0] == " " and piece.isascii() and (word := piece[1:]).isalpha():
                    ids = array("I", [t.id for t in tokenize("Ġ" + word)]).tobytes()
                else:
                    ids = self.other(piece)
            if len(piece) <= 40:
                self[piece] = ids

    def other(self, piece: str) -> bytes:
        """A piece's ids, if it is not a space and an ASCII word."""
        word = piece[1:] if piece[0] in " \n" else piece
        if self.newline is None or not word.isalpha():
            return self[piece]
        shown = (" " + word if piece[0] == " " else word).encode().decode("latin-1").translate(BYTES)
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return self.newline + ids if piece[0] == "\n" else ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = PIECE.findall(text)
        out = list(map(self.get, pieces))
        if None in out:
            missing = [k for k, ids in enumerate(out) if ids is None]
            self.learn({pieces[k] for k in missing})
            now = self.__getitem__
            for k in missing:
                out[k] = now(pieces[k])
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
