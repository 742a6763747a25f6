"""Entity tables (files, groups, edges, tasks, scenes, samples, ...) seen in the generic test tables.

Every entity is a lazy projection of a table, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed clock and scene grid of the entity tables.
T0 = 1_700_000_000
GRID_MS = 2_500


def pick(column: str, n: int, values: list) -> F.Column:
    """A value by column modulo n; missing values are null."""
    out = F.lit(None)
    for k, v in enumerate(values):
        if v is not None:
            out = F.when(F.col(column) % n == k, F.lit(v)).otherwise(out)
    return out


class Tables:
    """Entities of one test directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        ext = pick("doc_id", 5, ["mp4", "mkv", "avi", "webm", "txt"])
        toxic = self.raw("labels").where("toxic = 1").select("doc_id", F.lit(T0 + 500_000).cast("long").alias("deleted_at"))
        d = self.raw("documents").join(toxic, "doc_id", "left")
        return d.select(
            F.col("doc_id").alias("id"),
            F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
            F.col("n_chars").cast("long").alias("size_bytes"),
            (F.lit(T0).cast("long") * 1_000_000_000 + F.col("doc_id") * 1_000_003).alias("mtime_ns"),
            F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") * 13).alias("inode"),
            F.sha2("text", 256).alias("content_hash"),
            pick("doc_id", 6, ["h264", "hevc", "av1", "vp9", "mpeg2video"]).alias("codec"),
            ext.alias("container"),
            (F.col("n_chars") * 40).cast("long").alias("duration_ms"),
            pick("doc_id", 4, [24_000, 25_000, 30_000, 60_000]).cast("int").alias("fps_x1000"),
            ((F.col("doc_id") % 97) * 10_000 + 500_000).alias("bitrate_bps"),
            pick("doc_id", 4, [3840, 1920, 1280]).cast("int").alias("width_px"),
            pick("doc_id", 4, [2160, 1080, 720]).cast("int").alias("height_px"),
            (F.lit(T0) + F.col("doc_id")).alias("first_seen_at"),
            (F.lit(T0 + 86_400) + F.col("doc_id")).alias("last_seen_at"),
            "deleted_at",
            ((F.col("doc_id") % 1000) / 8.0).alias("laplacian_variance"),
            ((F.col("doc_id") % 503) * 1.5).alias("dct_energy"),
            ((F.col("doc_id") % 29) / 64.0).alias("bpp"),
            pick("doc_id", 3, ["x264 preset=slow", "NVENC fast"]).alias("encoder_tags"),
        )

    @cached_property
    def active(self) -> DataFrame:
        return self.files.where("deleted_at is null")

    @cached_property
    def fingerprints(self) -> DataFrame:
        """One row for most files; tier2, partial and skip markers are there for some."""
        f = self.files.where("id % 10 <> 9")
        skip = F.when(F.col("id") % 12 == 0, "exact-full-dup").when(F.col("id") % 12 == 1, "timeout").when(F.col("id") % 12 == 2, "no-keyframes")
        return f.select(
            F.col("id").alias("file_id"), (F.col("id") % 3 != 0).alias("has_tier2"), (F.col("id") % 4 == 0).alias("has_partial"), skip.alias("skip_reason"),
            F.when(skip.isNotNull(), F.when(F.col("id") % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))).alias("skip_size"),
            F.when(skip.isNotNull(), F.col("mtime_ns")).alias("skip_mtime"),
        )

    @cached_property
    def phashes(self) -> DataFrame:
        from mirrorsift.functions.bits import phash_of_coefficients

        return self.raw("embeddings").select(F.col("vec_id").alias("file_id"), phash_of_coefficients("embedding").alias("phash"))

    @cached_property
    def scenes(self) -> DataFrame:
        """file_id, scene_index, ts_ms, phash: one scene for each line of a document."""
        lines = self.raw("documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("scene_index", "line"))
        value = F.conv(F.substring(F.md5("line"), 1, 15), 16, 10).cast("long")
        phash = F.when(F.trim("line") == "", F.lit(0).cast("long")).otherwise(value)
        return lines.select("file_id", F.col("scene_index").cast("long").alias("scene_index"), (F.col("scene_index") * GRID_MS).cast("long").alias("ts_ms"), phash.alias("phash"))

    @cached_property
    def sequences(self) -> DataFrame:
        """file_id, scenes ARRAY<STRUCT<ts_ms, phash>> in order."""
        return self.scenes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "phash"))).alias("scenes"))

    @cached_property
    def groups(self) -> DataFrame:
        """group_id, trust, non_transitive, best_file_id over members()."""
        g = self.members.groupBy("group_id", "trust").agg(F.min("file_id").alias("lowest"), F.max("file_id").alias("highest"))
        return g.select(
            "group_id", "trust", ((F.col("trust") == "VERY_LIKELY") & (F.col("group_id") % 5 == 0)).alias("non_transitive"),
            F.when(F.col("group_id") % 3 == 0, F.col("lowest")).when(F.col("group_id") % 3 == 1, F.col("highest")).alias("best_file_id"),
        )

    @cached_property
    def members(self) -> DataFrame:
        """group_id, trust, file_id: equal texts (EXACT), equal language and length (VERY_LIKELY), neighbours (POSSIBLE)."""
        d = self.raw("documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("h"))

        def bucket(keys: list[str], trust: str, base: int) -> DataFrame:
            g = d.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.collect_list("doc_id").alias("ids")).where(F.size("ids") > 1)
            return g.select((F.col("low") + base).alias("group_id"), F.lit(trust).alias("trust"), F.explode("ids").alias("file_id"))

        pairs = d.where("doc_id % 10 = 0").select((F.col("doc_id") + 2_000_000_000).alias("group_id"), F.lit("POSSIBLE").alias("trust"), F.explode(F.array("doc_id", F.col("doc_id") + 1)).alias("file_id"))
        return bucket(["h"], "EXACT", 0).unionByName(bucket(["lang", "n_chars"], "VERY_LIKELY", 1_000_000_000)).unionByName(pairs)

    @cached_property
    def edges(self) -> DataFrame:
        """Star edges of each group from its smallest member, with spans for POSSIBLE groups."""
        low = self.groups.select("group_id")
        m = self.members.join(low, "group_id")
        first = m.groupBy("group_id").agg(F.min("file_id").alias("file_a"))
        e = m.join(first, "group_id").where("file_id <> file_a")
        possible = F.col("trust") == "POSSIBLE"
        b = F.col("file_id")
        span = lambda x: F.when(possible, x.cast("long"))
        return e.select(
            "group_id", "trust", "file_a", b.alias("file_b"), (F.lit(1000) - b % 100).cast("long").alias("score_x1000"),
            span(b % 7 * 1000).alias("clip_start_ms"), span(b % 7 * 1000 + 9000).alias("clip_end_ms"), span(b % 11 * 2000).alias("source_start_ms"),
            span(b % 11 * 2000 + 9000).alias("source_end_ms"), span(b % 5 + 1).alias("matched_scenes"), span(b % 5 + 3).alias("clip_scenes"), (b % 4 == 0).alias("intro_outro"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        o, key = self.raw("orders"), F.col("o_orderkey")
        state = F.when(key % 11 == 0, "FAILED").when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("DONE")
        first = F.substring("o_orderpriority", 1, 1)
        error = F.when(key % 11 == 0, F.when(key % 2 == 0, "database is locked").when(key % 3 == 0, "No such file or directory").otherwise("unsupported codec"))
        return o.select(
            key.alias("id"), pick("o_orderkey", 3, ["index", "densify", "partial"]).alias("kind"), state.alias("state"),
            F.when(first.isin("1", "2"), 0).when(first == "3", -100).otherwise(-200).cast("long").alias("priority"),
            F.when(key % 17 != 0, F.concat(F.lit("/f/"), F.col("o_custkey").cast("string"))).alias("path"),
            F.when(key % 5 == 0, "Remove").when(key % 5 == 1, "ForceUpsert").otherwise("Upsert").alias("change"),
            (key % 4).alias("attempts"), F.unix_timestamp("o_orderdate").alias("enqueued_at"), F.floor("o_totalprice").cast("long").alias("size_bytes"), error.alias("last_error"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        """Progress samples, one a day for each series: series, ts_ms, pending, running, done, failed, pending_bytes."""
        e = self.raw("events").withColumn("series", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string"))).withColumn("day", F.floor(F.unix_timestamp("ts") / 86_400))
        d = e.groupBy("series", "day").agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("p"))
        run = d.selectExpr("*", "sum(n) over (partition by series order by day) as upto", "sum(n) over (partition by series) as total")
        return run.select(
            "series", (F.col("day") * 86_400_000).alias("ts_ms"), (F.col("total") - F.col("upto")).alias("pending"), (F.col("p") % 3).alias("running"), F.col("upto").alias("done"),
            (F.col("p") % 2).alias("failed"), ((F.col("total") - F.col("upto")) * 1000).alias("pending_bytes"),
        )

    @cached_property
    def changes(self) -> DataFrame:
        """File events: ts, path, kind, ext."""
        e = self.raw("events")
        kind = F.when(F.col("event_id") % 6 == 0, "create").when(F.col("event_id") % 6 == 1, "modify").when(F.col("event_id") % 6 == 2, "remove").when(F.col("event_id") % 6 == 3, "rename_to").when(F.col("event_id") % 6 == 4, "rename_from").otherwise("rename_both")
        ext = F.when(F.col("user_id") % 4 == 0, ".MP4").when(F.col("user_id") % 4 == 1, ".mkv").when(F.col("user_id") % 4 == 2, ".txt").otherwise("")
        path = lambda k: F.concat(F.lit("/u/"), ((F.col("user_id") + k) % 150).cast("string"), ext)
        return e.select("event_id", "ts", kind.alias("kind"), path(0).alias("path"), F.when(kind == "rename_both", path(4)).alias("new_path"))

    @cached_property
    def listing(self) -> DataFrame:
        """The listing of now: path, size_bytes, mtime_ns, inode."""
        p = self.raw("pages").where("page_id % 9 <> 4")
        return p.select(
            F.concat("url", F.lit("/"), F.col("page_id").cast("string"), F.lit(".mp4")).alias("path"), F.length("html").cast("long").alias("size_bytes"),
            (F.col("page_id") * 1000 + F.when(F.col("page_id") % 13 == 0, 7).otherwise(0)).alias("mtime_ns"), F.when(F.col("page_id") % 3 != 0, F.col("page_id") + F.when(F.col("page_id") % 17 == 0, 1).otherwise(0)).alias("inode"),
        )

    @cached_property
    def previous(self) -> DataFrame:
        """The listing before."""
        p = self.raw("pages").where("page_id % 8 <> 3")
        return p.select(
            F.concat("url", F.lit("/"), F.col("page_id").cast("string"), F.lit(".mp4")).alias("path"),
            (F.length("html") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).cast("long").alias("size_bytes"), (F.col("page_id") * 1000).alias("mtime_ns"),
            F.when(F.col("page_id") % 4 != 0, F.col("page_id")).alias("inode"),
        )
