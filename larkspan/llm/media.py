"""Operator 9: documents as interleaved sequences of text and media, with payloads resolved by digest.

parse_html() turns a page into ordered elements: text, or a media reference with its address, digest and caption. Text ends
at block-level tags. A figure's caption is its media's, wherever it stands in the figure; else the alternative text is. A
picture, video or audio is one reference, whatever number of sources it names. An address is a digest itself (`sha256:..`)
or is looked up in a table of addresses and digests. A media store holds payloads as Parquet rows of binary PGM images (64 eight-bit
samples a line), keyed by the SHA-256 of the stored bytes. Payloads are described where they are read; only digests, positions and
captions are joined, so no payload is shuffled and a payload that many documents share costs no more than its references. Facts
of payloads are written before the join, so that Spark can split the references to a hot one.

Defined results: a null text is an empty payload (64 zero bytes); null ids stay null; a very long text is one image of as many
lines as it takes (up to the 2 GB of a binary value); equal texts give equal values; ties can't arise;
repeated rows give repeated rows; null HTML has no elements; references without a stored payload keep their place,
with nulls; empty tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import contextlib
import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, remove_at_exit, table

LINE = 64
ELEMENTS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


# Tags that end the text before them, as browsers lay them out by default; and tags whose text isn't shown.
BLOCKS = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
UNSEEN = {"script", "style", "template"}
GROUPS = {"picture", "video", "audio"}


class Elements(HTMLParser):
    """Collects text and media in document order."""

    def __init__(self, base: str | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.base = base
        self.out: list[dict] = []
        self.text: list[str] = []
        self.unseen = 0
        self.figures: list[dict] = []  # open ones: where their elements begin, and their caption with its place
        self.caption_depth = 0
        self.group: dict | None = None  # an open picture, video or audio

    def end_text(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text = []
        if words and self.caption_depth and self.figures:
            figure = self.figures[-1]
            figure["at"] = len(self.out) if figure["at"] is None else figure["at"]
            figure["caption"] = " ".join(filter(None, (figure["caption"], words)))
        elif words:
            self.out.append({"kind": "text", "text": words, "digest": None, "caption": None})

    def media(self, address: str, caption: str | None) -> dict:
        self.end_text()
        if self.base and address and not address.startswith("sha256:"):
            with contextlib.suppress(ValueError):
                address = urljoin(self.base, address)
        one = {"kind": "media", "text": address, "digest": address[7:] if address.startswith("sha256:") else None, "caption": caption or None}
        self.out.append(one)
        return one

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        source = a.get("src") or a.get("data-src") or (a.get("srcset", "").split() or [""])[0].rstrip(",")
        label = a.get("alt") or a.get("title") or a.get("aria-label")
        if tag in UNSEEN:
            self.unseen += 1
        elif tag in GROUPS:
            self.end_group()
            self.end_text()
            self.group = {"address": source, "label": label}
        elif tag in ("img", "source") and self.group is not None:
            first = tag == "img" and source  # a picture's own image stands before its other sources
            self.group["address"] = source if first or not self.group["address"] else self.group["address"]
            self.group["label"] = self.group["label"] or label
        elif tag in ("img", "source"):
            self.media(source, label)
        elif tag in BLOCKS:
            self.end_text()
            if tag == "figure":
                self.figures.append({"from": len(self.out), "caption": None, "at": None})
            elif tag == "figcaption":
                self.caption_depth += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif tag in GROUPS:
            self.end_group()
        elif tag in BLOCKS:
            self.end_text()
            if tag == "figcaption":
                self.caption_depth = max(0, self.caption_depth - 1)
            elif tag == "figure" and self.figures:
                self.end_group()
                self.end_figure()

    def end_group(self) -> None:
        if self.group is not None:
            group, self.group = self.group, None
            self.text = []  # what a browser shows only if it can't play the media
            self.media(group["address"], group["label"])

    def end_figure(self) -> None:
        figure = self.figures.pop()
        own = [x for x in self.out[figure["from"] :] if x["kind"] == "media"]
        if figure["caption"] and not own:
            self.out.insert(figure["at"], {"kind": "text", "text": figure["caption"], "digest": None, "caption": None})
        elif figure["caption"]:
            for x in own:
                x["caption"] = figure["caption"]

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)

    def end(self) -> list[dict]:
        self.close()
        self.end_group()
        self.end_text()
        while self.figures:
            self.end_figure()
        return [{"pos": i, **x} for i, x in enumerate(self.out)]


def parse_html(html: str | None, base: str | None = None) -> list[dict]:
    p = Elements(base)
    p.feed(html or "")
    return p.end()


def with_elements(pages: DataFrame, html: str = "html", base: str | None = None) -> DataFrame:
    """The columns of `pages`, `html` replaced by its `elements`; `base` names the column to which addresses are relative."""
    at = pages.columns.index(html)
    base_at = pages.columns.index(base) if base else None
    schema = ", ".join(f"`{n}` {ELEMENTS if i == at else t}" for i, (n, t) in enumerate(pages.dtypes))
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            bases = [None] * b.num_rows if base_at is None else b.column(base_at).to_pylist()
            columns[at] = pa.array([parse_html(x.as_py(), y) for x, y in zip(columns[at], bases, strict=True)], kind)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return pages.mapInArrow(parse, schema).withColumnRenamed(html, "elements")


def as_media(data: Column) -> Column:
    """Bytes as a PGM image: zeros fill the last line, and there is at least one."""
    n = F.octet_length(data)
    lines = F.greatest(F.ceil(n / LINE), F.lit(1)).cast("int")
    head = F.concat(F.lit(f"P5\n{LINE} "), lines.cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(head, data, F.unhex(F.repeat(F.lit("00"), lines * LINE - n)))


def samples_of(media: bytes) -> bytes:
    kind, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or width * height != len(samples):
        raise ValueError("not an 8-bit PGM image")
    return samples


def feature_of(samples: bytes) -> str:
    """Size, mean, deviation, a 4-bin histogram and the share of rising neighbours, all from exact sums."""
    x = np.frombuffer(samples, dtype=np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    bins = np.bincount(x >> 6, minlength=4)
    rising = int((x[1:] > x[:-1]).sum())
    return f"{LINE}x{len(x) // LINE};s={total};q={squares};h={','.join(map(str, bins))};r={rising}"


def media_facts(store: DataFrame) -> DataFrame:
    """store: digest, media. One row a digest, computed from the bytes as read."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, dict] = {}
            for digest, stored in zip(b.column("digest"), b.column("media"), strict=True):
                if (k := digest.as_py()) not in seen:
                    raw = stored.as_py()
                    s = samples_of(raw)
                    seen[k] = {"digest": k, "payload_bytes": len(s), "payload_sha256": hashlib.sha256(s).hexdigest(), "tail_crc32": zlib.crc32(s[-LINE:]), "media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest(), "feature": feature_of(s)}
            yield pa.RecordBatch.from_pylist(list(seen.values()), pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))

    return store.mapInArrow(facts, FACTS).dropDuplicates(["digest"])


def resolve(sequences: DataFrame, facts: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """A row an element: the sequences' other columns, the element's, and the facts of its payload where it has one.

    facts: as media_facts() gives them, read from a table; addresses: (address, digest), one row an address.
    """
    rows = sequences.withColumn("element", F.explode("elements")).select(*[c for c in sequences.columns if c != "elements"], "element.*")
    if addresses is not None:
        named = cut(addresses.select(F.col("address").alias("_address"), F.col("digest").alias("_digest")).dropna().groupBy("_address").agg(F.min("_digest").alias("_digest")), "addresses")
        is_media = (F.col("kind") == "media") & F.col("digest").isNull()
        rows = rows.join(named, F.when(is_media, F.col("text")) == F.col("_address"), "left").withColumn("digest", F.coalesce("digest", "_digest")).drop("_address", "_digest")
    return rows.join(facts, "digest", "left")


def interleaved(pages: DataFrame, facts: DataFrame, key: str = "page_id", html: str = "html", base: str | None = None, addresses: DataFrame | None = None) -> DataFrame:
    """Per distinct (key, html): its elements in order, media resolved."""
    extra = [pages[base]] if base else []
    version = F.xxhash64(pages[html], *extra).alias("version")
    sequences = with_elements(pages.select(pages[key], pages[html], version, *extra).dropDuplicates([key, "version"]), html, base).select(key, "version", "elements")
    rows = resolve(sequences, cut(facts, "facts"), addresses)
    parts = ["pos", "kind", "text", "digest", "caption", "payload_bytes", "payload_sha256", "feature"]
    found = rows.groupBy(key, "version").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("elements"))
    return sequences.select(F.col(key).alias("_key"), F.col("version").alias("_version")).join(found, F.col("_key").eqNullSafe(F.col(key)) & F.col("_version").eqNullSafe(F.col("version")), "left").select(F.col("_key").alias(key), F.coalesce("elements", F.array()).alias("elements"))


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Stores each text as media, makes an interleaved page that refers to it, parses the page and resolves it."""
    spark = docs.sparkSession
    data = F.coalesce(docs["text"], F.lit("")).cast("binary")
    coded = docs.select(docs["doc_id"], F.octet_length(data).cast("long").alias("n_bytes"), as_media(data).alias("media"))
    path = new_path(spark, "media")
    coded.select(F.sha2("media", 256).alias("digest"), "media").write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    facts = cut(media_facts(spark.read.schema("digest string, media binary").parquet(path)), "facts")
    page = F.concat(F.lit("<article><p>document</p><figure><img src=\"sha256:"), F.sha2("media", 256), F.lit("\"><figcaption>"), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    sequences = with_elements(coded.select("doc_id", "n_bytes", page.alias("html")))
    return resolve(sequences, facts)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = documents_as_media(table(spark, sf_dir, "documents")).filter("kind = 'media'")
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption")
