"""The data model as Spark DDL."""

VOICE_FX = "struct<pitch_semitones:double,speed:double,tone:string>"
CHARACTER = f"struct<id:string,name:string,gender:string,age_range:string,personality_traits:array<string>,voice_description:string,speaking_style:string,discovered_in_pass2:boolean,voice_fx:{VOICE_FX}>"
LINE = f"struct<line_id:string,speaker:string,text:string,emotion:string,speed:double,voice_fx:{VOICE_FX},pause_before_ms:int,pause_after_ms:int>"
VOICE = "struct<file:string,description:string,gender:string,duration_seconds:double,sample_rate:int,ref_text:string,generated_at:timestamp>"
CHAPTER = "struct<number:int,title:string,text:string,word_count:int>"
BOOK = f"metadata struct<title:string,author:string,language:string,total_chapters:int,total_words:bigint,cover_image_path:string>, chapters array<{CHAPTER}>"
SCRIPT_CHAPTER = f"chapter_number int, chapter_title string, chapter_summary string, lines array<{LINE}>"
QUALITY_LOGS = "id bigint, project_id string, line_id string, chapter_number int, attempt int, wer double, quality_score double, status string, details string, created_at string"
JOBS = "project_id string, state string, created_at string, updated_at string"
QUALITY_RESULT = "line_id string, status string, wer double, transcribed_text string, duration_seconds double, expected_duration_seconds double, peak_dbfs double, noise_floor_db double, clipping_detected boolean, quality_score double, attempt int"

#: Ranges that a field must keep, null being allowed: what lies outside is set aside, not dropped.
RANGES = {
    "speed": (0.5, 2.0),
    "pause_before_ms": (0, 5000),
    "pause_after_ms": (0, 5000),
    "pitch_semitones": (-12.0, 12.0),
    "wer": (0.0, 1.0),
    "quality_score": (0.0, 1.0),
}


def split_by_ranges(df):
    """``df`` as (rows within all ranges of the columns it has, rows that break one)."""
    from functools import reduce

    from pyspark.sql import functions as F

    rules = [F.coalesce(F.col(c).between(lo, hi), F.lit(True)) for c, (lo, hi) in RANGES.items() if c in df.columns]
    ok = reduce(lambda a, b: a & b, rules, F.lit(True))
    return df.where(ok), df.where(~ok)
