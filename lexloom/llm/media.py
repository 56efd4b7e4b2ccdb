"""Media columns: interleaved document sequences.

`parse_sequence` turns HTML into ordered structs of text and media references (a figure's
caption stays with its image). Payloads live in a media table keyed by SHA-256 digest, each
stored once by every task that meets it; a join on the digest resolves references, so copies
share a stored payload. The stored form is an 8-bit greyscale PNG of 64 samples a row.

Null texts and HTML count as empty: an empty sequence, or a payload of 64 zero bytes. A
reference without a stored payload keeps its place with null media columns. Equal texts give
equal values; repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.llm.base import per_text, slices, small_batches, stage

WIDTH = 64
LEVEL = 6  # of the stored form's compression
REMEMBER = 200_000  # digests that a task remembers
_MAGIC = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = len(payload) // WIDTH
    samples = np.zeros((rows, WIDTH + 1), np.uint8)  # each row starts with filter 0
    samples[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _MAGIC + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(samples.tobytes(), LEVEL)) + _part(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of a PNG that to_png made; every part's checksum is verified."""
    if stored[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, parts = 8, {}
    while at < len(stored):
        (n,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError(f"damaged {kind!r}")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    width, rows = struct.unpack_from(">II", parts[b"IHDR"])
    samples = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(rows, width + 1)
    if samples[:, 0].any():
        raise ValueError("a row filter that isn't used here")
    return samples[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Size, mean, deviation and the eight-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 5, minlength=8)
    return f"{WIDTH}x{len(x) // WIDTH};mean={x.mean():.4f};sd={x.std():.4f};hist=" + ",".join(map(str, shares))


class _Sequence(HTMLParser):
    """Ordered items of a page: text blocks and media references with their captions."""

    MEDIA = {"img": "src", "audio": "src", "video": "src", "source": "src"}
    BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 td th tr br section article blockquote pre ul ol table figure nav header footer title body".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None
        self.captions: list[str] = []  # of the open figure, or outside any

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        self.text = []
        if said:
            self.items.append({"position": len(self.items), "kind": "text", "text": said, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.MEDIA and attrs.get(self.MEDIA[tag]):
            self.flush()
            item = {"position": len(self.items), "kind": "media", "text": None, "ref": attrs[self.MEDIA[tag]], "caption": attrs.get("alt") or None}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)
        elif tag == "figcaption":
            self.flush()
            self.end_caption()
            self.caption = []
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_figure()
                self.figure = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_figure()

    def end_caption(self) -> None:
        if self.caption is not None:
            self.captions.append("".join(self.caption))
            self.caption = None
            if self.figure is None:
                self.end_figure()

    def end_figure(self, closed: bool = True) -> None:
        """The caption goes to all media of the figure, or is a text if there are none; a figure that the page leaves open makes no text."""
        self.end_caption()
        captions, self.captions, figure, self.figure = self.captions, [], self.figure, None
        said = " ".join(" ".join(captions).split())
        for item in figure or ():
            item["caption"] = said or item["caption"]
        if said and not figure and (closed or figure is None):
            self.items.append({"position": len(self.items), "kind": "text", "text": said, "ref": None, "caption": None})

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    p.end_figure(closed=False)
    return p.items


ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, items): the ordered text and media structs of each page."""
    return per_text(pages, key, f"items array<{ITEM}>", lambda: lambda texts: [[parse_sequence(t) for t in texts]], html)


def media_table(texts: DataFrame, text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """(digest, media): the payloads in stored form, as a table in the shared folder.

    A task stores a payload once (it remembers the last `remember` digests), so copies share a
    payload within a task and the payloads never move; tasks that met the same text have equal
    rows, of which readers take any.
    """
    small_batches(texts.sparkSession)
    at = texts.select(text).columns[0]
    schema = pa.schema([("digest", pa.string()), ("media", pa.binary())])

    def store(batches):
        seen: dict[str, None] = {}
        for part in (x for b in batches for x in slices(b, at)):
            digests, stored = [], []
            for t in part.column(at).to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(raw).hexdigest()
                if digest not in seen:
                    digests.append(digest)
                    stored.append(to_png(pad(raw)))
                    seen[digest] = None
                    if len(seen) > remember:
                        del seen[next(iter(seen))]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(stored, pa.binary())], schema=schema)

    return stage(texts.select(F.col(text).cast("string").alias(at)).mapInArrow(store, "digest string, media binary"), "media")


FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_facts(media: DataFrame) -> DataFrame:
    """(digest, FACTS) of each distinct stored payload, from the bytes read back."""
    schema = T.StructType.fromDDL("digest string, " + FACTS)
    types = [to_arrow_type(f.dataType) for f in schema]

    def read(batches):
        for b in batches:
            rows = []
            for digest, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = from_png(stored)
                rows.append((digest, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(x)))
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=schema.names)

    facts = media.select("digest", "media").mapInArrow(read, schema)
    return facts.groupBy("digest").agg(F.first(F.struct(*schema.names[1:])).alias("x")).select("digest", "x.*")


def resolve(sequence: DataFrame, facts: DataFrame, key: str, prefix: str = "media:") -> DataFrame:
    """(key, position, caption, digest, FACTS): one row per media item, in place; facts by digest."""
    items = sequence.select(key, F.explode("items").alias("item")).where("item.kind = 'media'")
    flat = items.select(key, "item.position", "item.caption", F.regexp_replace("item.ref", f"^{prefix}", "").alias("digest"))
    return flat.join(facts, "digest", "left")


def document_media(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, FACTS): each document as a figure that refers to its stored payload."""
    text = F.coalesce(F.col("text"), F.lit(""))
    figures = docs.select(
        key, F.format_string('<figure><img src="media:%s"><figcaption>%d</figcaption></figure>', F.sha2(text, 256), F.octet_length(text)).alias("html")
    )
    found = resolve(sequences(figures, key), media_facts(media_table(docs)), key)
    return found.select(key, F.col("caption").cast("long").alias("n_bytes"), *[x.split()[0] for x in FACTS.split(", ")])
