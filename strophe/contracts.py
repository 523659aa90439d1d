"""Fixed dimensions, and the views of tables that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tag ids by category.
CATEGORY_TAGS = {
    "genre": ["classical", "jazz"],
    "music_period": ["baroque", "classical", "romantic", "impressionist"],
    "composer": ["beethoven", "debussy", "brahms", "rachmaninoff", "schumann", "mozart", "liszt", "bach", "chopin", "schubert"],
    "form": ["nocturne", "sonata", "improvisation", "etude", "fugue", "waltz"],
    "pianist": ["hisaishi", "hancock", "bethel", "einaudi", "clayderman", "ryuichi", "yiruma", "hillsong"],
    "emotion": ["happy", "sad", "calm", "tense"],
}
#: Keys and values that manual metadata may have.
MANUAL_METADATA = {
    "genre": ["classical", "jazz"],
    "form": ["sonata", "prelude", "nocturne", "étude", "waltz", "mazurka", "impromptu", "fugue"],
    "composer": ["bach", "beethoven", "mozart", "chopin", "rachmaninoff", "liszt", "debussy", "schubert", "brahms", "ravel", "satie", "scarlatti"],
}
#: Textual meta-message types, and the instrument classes that are dropped by default.
TEXT_META = ["text", "copyright", "track_name", "instrument_name", "lyrics", "marker", "cue_marker", "device_name"]
DROPPED_INSTRUMENTS = ["chromatic", "synth_pad", "synth_effect", "ethnic", "percussive", "sfx"]


def tag_table(spark: SparkSession) -> DataFrame:
    """(category, tag, tag_id): a few dozen rows."""
    return spark.createDataFrame([(c, t, i) for c, tags in CATEGORY_TAGS.items() for i, t in enumerate(tags)], "category string, tag string, tag_id int")


def notes_view(events: DataFrame) -> DataFrame:
    """Notes of the event table: (piece_id, note_id, onset, dur, pitch, velocity, instrument), times in whole seconds from
    the piece's first event."""
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    rows = events.select(
        F.col("user_id").alias("piece_id"), F.col("event_id").alias("note_id"), second.alias("second"), F.floor("value").cast("long").alias("dur"),
        F.get_json_object("props", "$.k").cast("int").alias("pitch"), F.pmod(F.floor("value").cast("long"), F.lit(128)).cast("int").alias("velocity"), F.col("event_type").alias("instrument"),
    )
    first = rows.groupBy("piece_id").agg(F.min("second").alias("first"))
    return rows.join(first, "piece_id").select("piece_id", "note_id", (F.col("second") - F.col("first")).alias("onset"), "dur", "pitch", "velocity", "instrument")
