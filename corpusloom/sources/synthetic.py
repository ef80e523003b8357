"""Made-up chats for tests and drills: the same ones for the same seed, however they are partitioned."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

WORDS = tuple("amber boat candle delta ember field garnet harbor island juniper kettle lantern meadow needle orchard pebble quarry river saddle timber".split())


def chat(spark: SparkSession, n: int, seed: int = 0, words: Sequence[str] = WORDS, most_turns: int = 4, most_words: int = 12) -> DataFrame:
    """(doc_id, text): dialogues of one to ``most_turns`` exchanges; document i is drawn with seed * 100000 + i."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for i in pdf["id"]:
                rng = random.Random(seed * 100_000 + int(i))
                say = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, most_words)))  # noqa: B023, E731
                texts.append("\n\n".join(f"### Human: {say()}?\n\n### Assistant: {say()}." for _ in range(rng.randint(1, most_turns))))
            yield pd.DataFrame({"doc_id": pdf["id"], "text": texts})

    return spark.range(n).mapInPandas(draw, "doc_id bigint, text string")
