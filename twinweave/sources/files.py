"""File listings as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions.fingerprints import extension

#: Extensions of each media type, in order of precedence (fixed values).
MEDIA = {
    "photo": "jpg jpeg png heic heif tiff tif webp gif bmp raw cr2 cr3 nef nrw arw dng orf pef rw2 sr2 x3f erf raf dcr kdc mrw mos srw fff psd ai eps svg".split(),
    "video": "mp4 mov avi mkv wmv flv webm m4v 3gp mts m2ts ogv prores dnxhd xdcam xavc r3d ari arri".split(),
    "audio": "mp3 wav aac m4a flac ogg oga opus alac ape wv tak tta aiff aif au ra rm wma ac3 dts mpc spx vorbis amr 3ga".split(),
}
#: Format, media type, hex of the first bytes, and hex that must follow in the first 16 bytes (fixed values).
MAGIC = (
    ("jpeg", "photo", "FFD8FF", ""), ("png", "photo", "89504E47", ""), ("gif", "photo", "47494638", ""), ("bmp", "photo", "424D", ""), ("tiff", "photo", "49492A00", ""),
    ("tiff", "photo", "4D4D002A", ""), ("webp", "photo", "52494646", "57454250"), ("mpeg", "video", "000001BA", ""), ("mpeg", "video", "000001B3", ""), ("mov", "video", "00000018", ""),
    ("mov", "video", "00000020", ""), ("mkv", "video", "1A45DFA3", ""), ("flv", "video", "464C5601", ""), ("mp3", "audio", "FFFB", ""), ("mp3", "audio", "FFF3", ""),
    ("mp3", "audio", "FFF2", ""), ("mp3", "audio", "494433", ""), ("wav", "audio", "52494646", "57415645"), ("ogg", "audio", "4F676753", ""), ("flac", "audio", "664C6143", ""),
    ("midi", "audio", "4D546864", ""), ("ra", "audio", "2E7261FD", ""), ("aiff", "audio", "464F524D", ""), ("m4a", "audio", "4D344120", ""),
)
#: Marks of managed photo libraries (fixed values).
LIBRARIES = ("photos library.photoslibrary", ".lightroom", ".aperture", ".iphoto")
#: Marks of cloud-sync folders (fixed values).
CLOUD = ("icloud", "dropbox", "google drive", "onedrive", "box")


@dataclass(frozen=True)
class Exclude:
    """A rule: prefix, suffix, contains or glob with its text, or hidden, bundle or cloud."""

    kind: str
    text: str = ""

    def matches(self, path: str = "path", strict_glob: bool = False) -> Column:
        p, last = F.col(path), F.substring_index(F.col(path), "/", -1)
        if self.kind == "glob":
            # as a pattern anywhere in the path, or over the whole path with the dot as itself
            text = self.text.replace(".", r"\.") if strict_glob else self.text
            text = text.replace("*", ".*").replace("?", ".")
            return p.rlike(f"^{text}$" if strict_glob else text)
        return {
            "prefix": lambda: p.startswith(self.text),
            "suffix": lambda: p.endswith(self.text),
            "contains": lambda: p.contains(self.text),
            "hidden": lambda: last.startswith("."),
            "bundle": lambda: last.rlike(r"\.(app|framework|bundle)$"),
            "cloud": lambda: _any(F.lower(p), CLOUD),
        }[self.kind]()


#: What a scan leaves out unless told otherwise (fixed values).
DEFAULT_EXCLUDES = (
    Exclude("hidden"), Exclude("bundle"), Exclude("cloud"), Exclude("prefix", "/System"), Exclude("prefix", "/Applications"), Exclude("prefix", "/Library"), Exclude("prefix", "/usr"),
    Exclude("prefix", "/bin"), Exclude("prefix", "/sbin"), Exclude("contains", "Photos Library.photoslibrary"), Exclude("contains", ".Trash"), Exclude("contains", "tmp"),
    Exclude("suffix", ".tmp"), Exclude("suffix", ".cache"),
)


def _any(c: Column, texts) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | c.contains(t)
    return out


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """A1: (path, size, modified_s) of all files below a folder; contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_s"))


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """(path, head): the first 16 bytes of each file as hex; no more of a file is read, so its size doesn't matter.

    Executors open the files by Arrow's file systems (local, HDFS, S3, GCS). A
    file that can't be opened has a null head.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                try:
                    # Hadoop writes local paths with one slash
                    system, inside = FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and path[6:7] != "/" else path)
                    with system.open_input_file(inside) as f:
                        found.append(f.read(16).hex().upper())
                except OSError:
                    found.append(None)
            yield pa.record_batch([b.column(0), pa.array(found, pa.string())], names=["path", "head"])

    return listing(spark, folder).select("path").mapInArrow(read, "path string, head string")


def media_type(ext: Column) -> Column:
    """A2: media type of an extension; photo where it is unknown."""
    out = None
    for name, known in MEDIA.items():
        out = F.when(ext.isin(known), name) if out is None else out.when(ext.isin(known), name)
    return out.otherwise("photo")


def is_media(ext: Column, head: Column) -> Column:
    """A3: known extension, or known first bytes."""
    return ext.isin(sum(MEDIA.values(), [])) | sniffed(head).isNotNull()


def sniffed(head: Column, what: int = 0) -> Column:
    """A3: format (or with ``what`` 1 the media type) by the first bytes as hex; null if unknown."""
    out = F.lit(None).cast("string")
    for row in reversed(MAGIC):
        test = head.startswith(row[2])
        if row[3]:
            test = test & head.contains(row[3])
        out = F.when(test, row[what]).otherwise(out)
    return out


def inferred_format(system_id: Column, ext: Column, head: Column) -> Column:
    """A4: canonical format from the system's id unless generic, else the extension, else the first bytes, else unknown."""
    generic = system_id.isin("public.data", "public.content", "public.item", "dyn")  # fixed values
    named = F.when(~generic, F.lower(F.regexp_replace(system_id, r"^(public|com\.[a-z]+)\.", "")))
    named = F.when(named.rlike("raw-image$"), "raw").otherwise(named)
    same = F.when(ext == "jpg", "jpeg").when(ext == "tif", "tiff").when(ext == "heif", "heic").when(ext == "aif", "aiff").otherwise(ext)
    known = F.when(ext.isin(sum(MEDIA.values(), [])), same)
    return F.coalesce(named, known, sniffed(head), F.lit("unknown"))


def excluded(rules=DEFAULT_EXCLUDES, path: str = "path", strict_glob: bool = False) -> Column:
    """A5: whether any rule matches."""
    out = F.lit(False)
    for r in rules:
        out = out | r.matches(path, strict_glob)
    return out


def excluded_by_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """A5: files that no row of ``rules`` (kind prefix, suffix or contains; text) matches.

    An equi-join: the parts of a path that have the length of a rule's text, at
    its beginning, its end or anywhere, are looked up among the rules. The driver
    sees the rules' distinct lengths only. A file without a path is kept.
    """
    known = rules.select("kind", "text").filter("text is not null").distinct()
    lengths: dict[str, list[int]] = {"prefix": [], "suffix": [], "contains": []}
    for r in known.select("kind", F.length("text").alias("n")).distinct().collect():
        lengths.setdefault(r["kind"], []).append(r["n"])
    p = F.col("path")
    of = lambda kind: F.filter(F.array(*[F.lit(n) for n in sorted(lengths[kind])]).cast("array<int>"), lambda n: n <= F.length(p))
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    begins = F.transform(of("prefix"), lambda n: part("prefix", F.substring(p, F.lit(1), n)))
    ends = F.transform(of("suffix"), lambda n: part("suffix", F.substring(p, F.length(p) - n + 1, n)))
    inside = F.flatten(F.transform(of("contains"), lambda n: F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: part("contains", F.substring(p, i, n)))))
    parts = files.select("path").distinct().select("path", F.explode(F.array_distinct(F.concat(begins, ends, inside))).alias("x")).select("path", "x.kind", "x.text")
    hit = parts.join(known, ["kind", "text"]).select("path").distinct()
    return files.join(hit, "path", "left_anti").select(*files.columns)


def in_library(path: str = "path") -> Column:
    """Whether a root is inside a managed library."""
    return _any(F.lower(F.col(path)), LIBRARIES)


def scan(files: DataFrame, rules=DEFAULT_EXCLUDES) -> DataFrame:
    """Rows (path, size, head) with their media type and what becomes of them: item, skipped or error."""
    ext = extension("path")
    outcome = F.when(in_library(), "error").when(excluded(rules), "skipped").when(is_media(ext, F.col("head")), "item").otherwise("skipped")
    return files.withColumns({"media_type": F.coalesce(F.when(ext.isin(sum(MEDIA.values(), [])), media_type(ext)), sniffed(F.col("head"), 1), F.lit("photo")), "outcome": outcome})


def scan_counters(scanned: DataFrame, seconds: float) -> DataFrame:
    """Files, media, skipped, errors and files a second."""
    n = F.count(F.lit(1))
    of = lambda k: F.count_if(F.col("outcome") == k)
    return scanned.agg(n.alias("total"), of("item").alias("media"), of("skipped").alias("skipped"), of("error").alias("errors"), (n / seconds if seconds > 0 else F.lit(0.0)).alias("files_per_s"))


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines."""
    df.write.json(path)


def normalised_metadata(df: DataFrame) -> DataFrame:
    """Capture time falls back to created, then modified; GPS is rounded to 6 places where both are there."""
    both = F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()
    place = lambda c: F.when(both, F.round(c, 6)).otherwise(F.col(c))
    return df.withColumns({"capture_s": F.coalesce("capture_s", "created_s", "modified_s"), "gps_lat": place("gps_lat"), "gps_lon": place("gps_lon")})


def parse_exif_date(c: Column) -> Column:
    """Seconds of ``yyyy:MM:dd HH:mm:ss`` in UTC, or of an ISO 8601 text; null otherwise."""
    exif = F.try_to_timestamp(F.concat(c, F.lit(" +0000")), F.lit("yyyy:MM:dd HH:mm:ss Z"))
    iso = F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return F.unix_timestamp(F.coalesce(exif, iso))


def format_exif_date(seconds: Column) -> Column:
    """Back to the EXIF form, in the session's time zone (UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy:MM:dd HH:mm:ss")


def keyword_list(c: Column) -> Column:
    """Parts between commas, trimmed, distinct, sorted; null if none."""
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")))
    return F.when(F.size(parts) > 0, parts)


SNAPSHOT = "file_name string, file_size long, width int, height int, capture_s long, gps_lat double, gps_lon double, camera_model string, keywords array<string>"


def snapshot(df: DataFrame) -> DataFrame:
    """(id, snapshot): metadata as JSON."""
    names = [f.split()[0] for f in SNAPSHOT.split(", ")]
    return df.select("id", F.to_json(F.struct(*names)).alias("snapshot"))


def from_snapshot(df: DataFrame) -> DataFrame:
    """And back."""
    return df.select("id", F.from_json("snapshot", SNAPSHOT).alias("s")).select("id", "s.*")


def fields_found(before: str, after: str, media: Column) -> Column:
    """How many fields ``after`` has that ``before`` lacks; dimensions count twice; photos don't count duration, others nothing but it and the words."""
    new = lambda c: (F.col(f"{before}.{c}").isNull() & F.col(f"{after}.{c}").isNotNull()).cast("int")
    words = new("keywords")
    photo = 2 * new("width") + new("capture_s") + new("camera_model") + new("gps_lat") + new("gps_lon") + words
    return F.when(media == "photo", photo).when(media == "video", 2 * new("width") + new("duration_sec") + words).otherwise(new("duration_sec") + words)
