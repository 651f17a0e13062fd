"""Speech models, language models and encoders as pluggable partition functions.

A loader runs once a task, as models are large; of several loaders the first
that works is used. The stubs are deterministic, for tests and dry runs.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transcriber = Callable[[str, float, float], list[tuple[float, float, str]]]
SEGMENTS = "video_id bigint, chunk_num bigint, seg_index int, start double, end double, text string, language string, model string"


def first_that_loads(loaders: list[tuple[str, Callable[[], object]]]) -> tuple[str, object]:
    """(name, model) of the first loader in order that doesn't raise."""
    failed = []
    for name, load in loaders:
        try:
            return name, load()
        except Exception as e:
            failed.append(f"{name}: {e}")
    raise RuntimeError("no model could be loaded: " + "; ".join(failed))


def plan_chunks(media: DataFrame, chunk_s: int = 120) -> DataFrame:
    """video_id, path, chunk_num, start, length: a medium of at most a chunk is one pass; rows without a duration are left out."""
    n = F.when(F.col("duration") <= chunk_s, F.lit(1)).otherwise(F.ceil(F.col("duration") / chunk_s)).cast("int")
    c = media.where(F.col("duration").isNotNull() & ~F.isnan("duration") & (F.col("duration") > 0)).select("video_id", "path", "duration", F.explode(F.sequence(F.lit(1), n)).alias("chunk_num"))
    start = (F.col("chunk_num") - 1) * float(chunk_s)
    return c.select("video_id", "path", F.col("chunk_num").cast("bigint").alias("chunk_num"), start.alias("start"), F.least(F.lit(float(chunk_s)), F.col("duration") - start).alias("length"))


def transcribed(chunks: DataFrame, loaders: list[tuple[str, Callable[[], Transcriber]]], language: str = "und") -> DataFrame:
    """Segments of planned chunks, times absolute; of a chunk only those that start in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, model = first_that_loads(loaders)
        for b in batches:
            rows = []
            for v, p, c, s, n in zip(b["video_id"], b["path"], b["chunk_num"], b["start"], b["length"]):
                kept = [x for x in model(p, s, n) if s <= x[0] < s + n]
                rows += [(v, c, i, a, e, t, language, name) for i, (a, e, t) in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["video_id", "chunk_num", "seg_index", "start", "end", "text", "language", "model"])

    # Chunks are the unit of work: each has its own length, so they are spread over the tasks.
    return chunks.repartition("video_id", "chunk_num").mapInPandas(run, SEGMENTS)


def stub_transcriber(step_s: float = 4.0) -> Transcriber:
    """A segment every ``step_s`` seconds, its text its time."""

    def model(path: str, start: float, length: float) -> list[tuple[float, float, str]]:
        n = int(length // step_s)
        return [(start + i * step_s, start + (i + 1) * step_s, f"segment at {start + i * step_s:.2f}") for i in range(n)]

    return model


def replies(prompts: DataFrame, key: str, prompt: str, ask: Callable[[], Callable[[str], str | None]]) -> DataFrame:
    """key, reply: a language model's answers; one client a task, a failed call is a null reply."""
    kind = dict(prompts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = ask()
        for b in batches:
            out = []
            for p in b["p"]:
                try:
                    out.append(client(p) if isinstance(p, str) else None)
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"key": b["key"], "reply": pd.Series(out, dtype=object)})

    return prompts.select(F.col(key).alias("key"), F.col(prompt).alias("p")).mapInPandas(run, f"key {kind}, reply string").withColumnRenamed("key", key)


def http_client(url: str, model: str, temperature: float = 0.3, most_tokens: int = 400, timeout_s: float = 90) -> Callable[[], Callable[[str], str | None]]:
    """A JSON-over-HTTP client of a locally served model."""

    def ask() -> Callable[[str], str | None]:
        import json
        from urllib.request import Request, urlopen

        def call(prompt: str) -> str | None:
            body = {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": temperature, "num_predict": most_tokens}}
            with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout_s) as r:
                return json.loads(r.read()).get("response") if r.status == 200 else None

        return call

    return ask


def model_served(served: Column, model: str) -> Column:
    """Whether one of an array of model names holds the name of the model's family, what stands before its colon; false for no names."""
    return F.coalesce(F.exists(served, lambda x: F.contains(x, F.lit(model.split(":")[0]))), F.lit(False))


def served_names(reply: Column) -> Column:
    """Names of the models in a service's list, ``{"models": [{"name": ...}]}``; none where it can't be read."""
    listed = F.from_json(reply, "models array<struct<name: string>>")["models"]
    return F.coalesce(F.filter(F.transform(listed, lambda m: m["name"]), lambda n: n.isNotNull()), F.array().cast("array<string>"))


def model_list(url: str, timeout_s: float = 2) -> str | None:
    """A service's list of models as it replies, None where there is no service. Asked once, by the driver."""
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=timeout_s) as r:
            return r.read().decode() if r.status == 200 else None
    except (OSError, ValueError):
        return None


def analysis_prompt(text: Column, language: str, most: int = 1500) -> Column:
    """Prompt that asks for the sections the analysis parser reads, over the head of a chunk's text."""
    return F.concat(
        F.lit(f"Analyse this passage of a lesson and answer in {language}.\n\nPassage:\n"), F.left(text, F.lit(most)),
        F.lit("\n\nAnswer with exactly these sections:\nSUMMARY:\n<two or three sentences>\nTOPICS:\n- <topic>\nHASHTAGS:\n#<tag>\nREEL SEGMENTS:\n[M:SS - M:SS] <reason>\n"),
    )


def selection_prompt(summaries: Column, min_s: int = 45, max_s: int = 70) -> Column:
    """Prompt that asks for the parts of a reel in the form the selection parser reads."""
    return F.concat(
        F.lit(f"Choose parts of this video for a reel of {min_s} to {max_s} seconds.\n\n"), summaries,
        F.lit("\n\nAnswer in this form:\nPARTS:\n1. [M:SS - M:SS] <reason>\nTOTAL_DURATION: <n>s\nNARRATIVE:\n<one paragraph>\nTITLE:\n<title>\n"),
    )


def chunk_prompt(text: Column, most: int = 1500) -> Column:
    """Prompt for one chunk as it arrives: a short summary, topics and one moment, over the head of its text."""
    return F.concat(
        F.lit("This is one passage of two minutes of a video. Say what THIS passage holds.\n\nPassage:\n"), F.left(text, F.lit(most)),
        F.lit("\n\nAnswer with exactly these sections:\nSUMMARY:\n<two or three sentences>\nTOPICS:\n- <topic>\nREEL:\n[M:SS] <why this moment>\n"),
    )


def cumulative_prompt(text: Column, chars: Column, chunk_num: Column, total: Column, most: int = 3000) -> Column:
    """Prompt for all chunks so far, over the head of their text; where there is more, how long the whole is (``chars``) stands under it."""
    more = F.when(chars > most, F.concat(F.lit("... (content continues, "), chars.cast("string"), F.lit(" total chars)"))).otherwise("")
    return F.concat(
        F.lit("These are chunks 1-"), chunk_num.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" of a video. Say what ALL of it holds so far.\n\nTranscript:\n"), F.left(text, F.lit(most)), F.lit("\n"), more,
        F.lit("\n\nAnswer with exactly these sections:\nSUMMARY:\n<three to five sentences>\nTOPICS:\n- <topic>\nHASHTAGS:\n#<tag> #<tag>\nTOP REELS:\n[M:SS] <why>\n"),
    )


def encode_command(path: Column, graph: Column, output: Column) -> Column:
    """Arguments of the encoder for a filter graph."""
    return F.array(F.lit("ffmpeg"), F.lit("-y"), F.lit("-i"), path, F.lit("-filter_complex"), graph, F.lit("-map"), F.lit("[outv]"), F.lit("-map"), F.lit("[outa]"), F.lit("-c:v"), F.lit("libx264"), F.lit("-c:a"), F.lit("aac"), output)


def run_commands(commands: DataFrame, key: str, command: str, run: Callable[[list[str]], int] | None = None) -> DataFrame:
    """key, code: exit codes of commands run in the tasks, -1 where one couldn't be started."""
    kind = dict(commands.dtypes)[key]
    start = run or (lambda c: subprocess.run(c, capture_output=True).returncode)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = []
            for c in b["c"]:
                try:
                    codes.append(int(start(list(c))))
                except OSError:
                    codes.append(-1)
            yield pd.DataFrame({"key": b["key"], "code": pd.Series(codes, dtype="int32")})

    return commands.select(F.col(key).alias("key"), F.col(command).alias("c")).mapInPandas(each, f"key {kind}, code int").withColumnRenamed("key", key)


def normalised_chunks(rows: DataFrame, keys: list[str], chunks: str, start: str) -> DataFrame:
    """keys, seg_index, start, end, text of recogniser chunks (array of struct(timestamp array<double>, text)).

    A chunk without both times gets the pass's start and thirty seconds; times
    count from the pass's start.
    """
    r = rows.select(*keys, F.col(start).alias("__s"), F.posexplode(chunks).alias("seg_index", "c"))
    a, b = F.get("c.timestamp", F.lit(0)), F.get("c.timestamp", F.lit(1))
    timed = (F.size("c.timestamp") == 2) & a.isNotNull() & b.isNotNull()
    return r.select(*keys, "seg_index", F.when(timed, F.col("__s") + a).otherwise(F.col("__s")).alias("start"), F.when(timed, F.col("__s") + b).otherwise(F.col("__s") + 30).alias("end"), F.col("c.text").alias("text"))


def audio_command(path: Column, output: Column) -> Column:
    """Arguments that extract a medium's sound as mono 16 kHz."""
    return F.array(F.lit("ffmpeg"), F.lit("-y"), F.lit("-i"), path, F.lit("-vn"), F.lit("-ac"), F.lit("1"), F.lit("-ar"), F.lit("16000"), output)
