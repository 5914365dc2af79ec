"""Views of the driver tables in this library's schemas.

Every view is deterministic, so the same view can be written in SQL (see
``parley.adapters.duck``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import clock
from parley.operators.ordered import row_chunk, running_total
from parley.session import spread
from parley.sources.tables import jurisdictions

TURN_MS = 600_000
# Tables whose rows cost much work each, by their row keys.
_ROW_KEYS = {
    "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
}
NOW = "2002-01-01 00:00:00"
BUNDLES = [
    "us.zoom.xos",
    "com.tinyspeck.slackmacgap.helper",
    "com.google.Chrome.canary",
    "com.google.Chrome.helper",
    "org.mozilla.firefox",
    "com.apple.FaceTime",
    "com.apple.CoreSpeech",
    "com.acme.SuperPhone",
    "org.example.cool-app",
    "com.microsoft.teams2",
    "com.microsoft.teamsX",
]


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


class Tables:
    """Lazily opened driver tables and the adapter views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._opened: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._opened:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self._opened[name] = spread(df, *_ROW_KEYS[name]) if name in _ROW_KEYS else df
        return self._opened[name]

    @cached_property
    def words(self) -> DataFrame:
        return conversation_words(self.raw("conversations"))

    @cached_property
    def call_ids(self) -> DataFrame:
        return self.raw("conversations").select(F.concat(F.lit("c"), "conv_id").alias("recording_id")).distinct()

    @cached_property
    def turns(self) -> DataFrame:
        """Two overlapping speaker turns per assistant turn; the tail is bare."""
        t = self.raw("conversations").filter("role = 'assistant'").select(
            F.concat(F.lit("c"), "conv_id").alias("recording_id"),
            "turn",
            (F.col("turn") * TURN_MS).alias("at"),
            (F.size(tokens(F.col("text"))).cast("long") * 400).alias("len"),
        )
        label = lambda k: F.concat(F.lit("Them "), ((F.col("turn") + k) % 3 + 1).cast("string"))
        secs = lambda ms: (ms / 1000.0).alias
        one = t.select(
            "recording_id",
            (F.col("turn") * 2).alias("seq"),
            secs(F.col("at"))("start"),
            secs(F.col("at") + F.floor(F.col("len") * 55 / 100))("end"),
            label(0).alias("label"),
        )
        two = t.select(
            "recording_id",
            (F.col("turn") * 2 + 1).alias("seq"),
            secs(F.col("at") + F.floor(F.col("len") * 50 / 100))("start"),
            secs(F.col("at") + F.floor(F.col("len") * 85 / 100))("end"),
            label(1).alias("label"),
        )
        return one.unionByName(two)

    @cached_property
    def signal(self) -> DataFrame:
        """Microphone edges per user, in milliseconds."""
        e = self.raw("events")
        return e.select(
            F.concat(F.lit("u"), "user_id").alias("key"),
            clock.millis(F.col("ts")).alias("ts"),
            F.col("event_id").alias("ord"),
            F.col("event_type").isin("click", "view", "purchase").alias("on"),
        )

    @cached_property
    def holders(self) -> DataFrame:
        """Input holders: one process per event, five events a snapshot."""
        e = self.raw("events")
        return e.select(
            F.concat(F.lit("u"), (F.col("user_id") % 7)).alias("key"),
            F.floor(F.col("event_id") / 5).cast("long").alias("snapshot_id"),
            F.floor(F.col("event_id") / 5).cast("long").alias("ts"),
            F.col("event_id").alias("ord"),
            pick(BUNDLES, F.col("user_id") % len(BUNDLES)).alias("bundle_id"),
            (F.col("event_id") % 13).alias("pid"),
        )

    @cached_property
    def recordings(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        bundle = F.when(F.col("o_custkey") % 12 < len(BUNDLES), pick(BUNDLES, F.col("o_custkey") % 12))
        app_names = F.when(F.col("o_custkey") % 12 == 11, F.lit("Webinar"))
        ms = clock.millis(F.col("o_orderdate")) + (k % 86_400) * 1000
        length = 20 + (k * 37) % 9000
        status = (
            F.when(F.col("o_orderstatus") == "F", F.when(k % 4 == 0, "failed").otherwise("done"))
            .when(F.col("o_orderstatus") == "O", F.when(k % 3 == 0, "recording").otherwise("pending_transcription"))
            .otherwise(F.when(k % 2 == 0, "transcribing").otherwise("pending_note"))
        )
        rid = F.concat(F.lit("r"), k.cast("string"))
        return o.select(
            rid.alias("id"),
            clock.from_millis(ms).alias("started_at"),
            F.when(k % 9 != 0, clock.from_millis(ms + length * 1000)).alias("ended_at"),
            app_names.alias("_w"),
            bundle.alias("bundle_id"),
            F.concat(F.lit("/rec/"), rid, F.lit(".wav")).alias("audio_path"),
            status.alias("status"),
            F.when(k % 5 < 3, F.concat(F.lit("/notes/"), rid, F.lit(".md"))).alias("note_path"),
            F.when(k % 7 < 3, F.concat(F.lit("error "), (k % 11).cast("string"))).alias("error"),
            F.when(k % 6 != 0, (length % 400).cast("double") / 4).alias("transcribe_secs"),
            clock.from_millis(ms + (k % 200) * 86_400_000).alias("updated_at"),
            k.alias("k"),
        )

    @cached_property
    def checkpoints(self) -> DataFrame:
        k = F.col("k")
        return self.recordings.filter(k % 8 < 3).select(
            "id",
            F.when(k % 8 == 2, 2).otherwise(1).alias("version"),
            F.when(k % 3 < 2, F.concat(F.lit("/cp/"), "id", F.lit(".md"))).alias("note_path"),
            (k % 16 < 3).alias("note_canonical"),
        )

    @cached_property
    def files(self) -> DataFrame:
        """A file listing: two of three audio files, one in ten only cleaned, half the notes."""
        r, k = self.recordings, F.col("k")
        audio = r.filter(k % 3 < 2).select(F.col("audio_path").alias("path"), ((k * 91) % 100_000 + 44).alias("length"))
        clean = r.filter(k % 10 == 2).select(
            F.concat(F.lit("/rec/"), "id", F.lit("-clean.wav")).alias("path"), ((k * 17) % 50_000 + 44).alias("length")
        )
        notes = r.filter((k % 5 < 3) & (k % 2 == 0)).select(
            F.col("note_path").alias("path"), ((k * 7) % 5000).alias("length")
        )
        return audio.unionByName(clean).unionByName(notes)

    @cached_property
    def jobs(self) -> DataFrame:
        """Jobs, one per distinct (order, line) pair."""
        ln = self.raw("lineitem")
        g = ln.groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_shipdate").alias("ship"), F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part")
        )
        k, n = F.col("l_orderkey"), F.col("l_linenumber")
        jid = k * 16 + n
        kind = F.when(F.col("flag") == "R", "sweep_expired").when(F.col("flag") == "N", "cleanup_staging").otherwise(
            "retry_transcription"
        )
        rid = F.concat(F.lit("r"), k.cast("string"))
        note = F.concat(F.lit("/job/"), rid, F.lit(".md"))
        payload = F.when(
            jid % 3 == 0,
            F.concat(
                F.lit('{"id":"'), rid, F.lit('","preferred_note":"'), note, F.lit('","note_canonical":'),
                F.when(jid % 2 == 0, "true").otherwise("false"), F.lit("}"),
            ),
        ).otherwise(F.concat(F.lit('{"id":"'), rid, F.lit('"}')))
        state = F.when(jid % 4 == 0, "running").when(jid % 4 == 1, "failed").otherwise("pending")
        return g.select(
            jid.cast("long").alias("id"),
            kind.alias("kind"),
            payload.alias("payload"),
            state.alias("state"),
            n.cast("int").alias("attempts"),
            F.lit(5).alias("max_attempts"),
            clock.from_millis(clock.millis(F.col("ship")) + (jid % 1000) * 1000).alias("next_run_at"),
            F.when(F.col("flag") == "R", F.lit(3600).cast("long")).alias("period_secs"),
            F.when(jid % 5 == 0, F.concat(F.lit("job error "), (jid % 7).cast("string"))).alias("last_error"),
            F.col("ship").alias("updated_at"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        """Vectors as 64-sample tracks in frames of 16, near one quiet at times.

        recording = vector, far = the next vector, clean = half the distance
        of mic to far, near = mic silenced in every second frame.
        """
        e = self.raw("embeddings").select("vec_id", "embedding")
        nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("far"))
        both = e.join(nxt, "vec_id").select(F.col("vec_id"), F.col("embedding").alias("mic"), "far")
        cut = both.select(
            F.concat(F.lit("v"), "vec_id").alias("recording_id"), "mic", "far", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("f")
        )
        part = lambda c: F.slice(c, F.col("f") * 16 + 1, F.lit(16))
        m, f = part("mic"), part("far")
        quiet = F.when(F.col("f") % 2 == 1, 0.001).otherwise(1.0)
        return cut.select(
            "recording_id",
            F.col("f").cast("long").alias("frame_no"),
            as_double(m).alias("mic"),
            as_double(f).alias("far"),
            F.zip_with(as_double(m), as_double(f), lambda a, b: a * 0.75 - b * 0.125).alias("clean"),
            F.transform(as_double(m), lambda a: a * quiet).alias("near"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        e = self.raw("events")
        level = (
            F.when(F.col("event_type") == "error", "ERROR")
            .when(F.col("event_type") == "signup", "WARN")
            .when(F.col("event_type") == "purchase", "DEBUG")
            .otherwise("INFO")
        )
        return e.select(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
            level.alias("level"),
            F.concat(F.lit("parley::"), "event_type").alias("target"),
            F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" "), "props").alias("message"),
            clock.millis(F.col("ts")).alias("at"),
            F.col("event_id").alias("ord"),
        )

    @cached_property
    def stages(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("ord"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
            F.when(F.col("event_type") == "error", "file").otherwise("transcribe").alias("stage"),
            F.when(F.col("user_id") % 3 == 0, "cloud").otherwise("local").alias("backend"),
            F.round(F.col("value") * 1000).cast("long").alias("duration_ms"),
        )

    @cached_property
    def threads(self) -> DataFrame:
        e = self.raw("events")
        u = F.col("user_id")
        return e.select(
            F.floor(F.col("event_id") / 40).cast("long").alias("snapshot_id"),
            F.concat(F.when(u % 5 == 0, "app-").otherwise("os-"), F.col("event_id").cast("string")).alias("name"),
            F.col("value").alias("cpu_pct"),
        )

    @cached_property
    def results(self) -> DataFrame:
        """Sweep rows, one per event: the n-th event of each type is a user's n-th run of that fixture."""
        e = self.raw("events").select("user_id", "event_type", "event_id", "value")
        u, k = F.col("user_id"), F.col("event_id")
        nth = running_total(e, ["user_id", "event_type"], ["event_id"], row_chunk("event_id"), F.lit(1), "n")
        run = F.when((u == 0) & (F.col("n") == 1), "baseline").otherwise(F.concat_ws(".", F.concat(F.lit("run"), u.cast("string")), F.col("n").cast("string")))
        return nth.select(
            run.alias("run"),
            F.col("event_type").alias("fixture"),
            F.when(F.col("event_type") == "click", 0)
            .when(F.col("event_type") == "error", 1)
            .when(F.col("event_type") == "purchase", 2)
            .when(F.col("event_type") == "signup", 3)
            .otherwise(4)
            .alias("fixture_ord"),
            F.when(k % 11 != 0, True).alias("ok"),
            (F.round(F.col("value") * 100) / 10000.0).alias("wer_norm"),
            (F.round(F.col("value") * 200) / 10000.0).alias("wer_raw"),
            (900 + k % 400).cast("double").alias("peak_rss_mb"),
            (5000 + (k * 13) % 20_000).cast("double").alias("asr_ms"),
            F.concat(F.lit('{"threads":'), (u % 8).cast("string"), F.lit("}")).alias("flags"),
            k.alias("k"),
        )

    @cached_property
    def parties(self) -> DataFrame:
        """Three parties per call: states, countries, and now and then nobody knows."""
        o = self.raw("orders").join(
            self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
        )
        j = jurisdictions(self.spark).select("id", "ord")
        seats = o.select(
            F.concat(F.lit("k"), "o_orderkey").alias("call_id"),
            "o_orderkey",
            "c_nationkey",
            F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"),
        )
        abroad = F.col("o_orderkey") % 6 == 0
        n = (F.col("o_orderkey") * 7 + F.col("c_nationkey") * 3 + F.col("ord") * 11).cast("long")
        idx = F.when(abroad, n % 66).otherwise(1 + n % 51)
        return seats.select("call_id", "ord", "o_orderkey", idx.cast("int").alias("_i")).join(
            j.withColumnRenamed("ord", "_i").withColumnRenamed("id", "jurisdiction_id"), "_i", "left"
        ).select(
            "call_id",
            "ord",
            F.coalesce("jurisdiction_id", F.lit("unknown")).alias("jurisdiction_id"),
            F.when(F.col("o_orderkey") % 2 == 0, "phone").otherwise("inPerson").alias("medium"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Reference turns and damaged copies: drop, replace or repeat words."""
        c = self.raw("conversations")
        return c.select(
            F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("fixture"),
            (F.col("turn") % 3).alias("damage"),
            F.col("text").alias("ref"),
            damaged(F.col("text"), F.col("turn") % 3).alias("hyp"),
        )


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t\n\r]+"), lambda w: w != "")


def as_double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def damaged(text: Column, mode: Column) -> Column:
    kept = F.transform(
        tokens(text),
        lambda w, i: F.when((mode == 0) & (i % 7 == 3), F.lit(""))
        .when((mode == 1) & (i % 5 == 2), F.lit("zzz"))
        .when((mode == 2) & (i % 6 == 1), F.concat(w, F.lit(" "), w))
        .otherwise(w),
    )
    return F.array_join(F.filter(kept, lambda w: w != ""), " ")


def conversation_words(c: DataFrame) -> DataFrame:
    """Timed words: 0.4 s apart, two more seconds after every seventh."""
    i = F.col("i").cast("long")
    at = F.col("turn") * TURN_MS + i * 400 + F.floor(i / 7) * 2000
    return c.select("conv_id", "turn", "role", F.posexplode(tokens(F.col("text"))).alias("i", "text")).select(
        F.concat(F.lit("c"), "conv_id").alias("recording_id"),
        F.when(F.col("role") == "user", 0).otherwise(1).alias("channel"),
        (F.col("turn") * 1000 + i).alias("seq"),
        (at / 1000.0).alias("start"),
        ((at + 350) / 1000.0).alias("end"),
        "text",
    )
