"""What the engine needs from models: vectors for texts, records for questions. Offline defaults."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.text import tokens


class Embedder(Protocol):
    dim: int

    def documents(self, text: Column) -> Column: ...

    def queries(self, text: Column) -> Column: ...


class HashEmbedder:
    """Signed feature hashing of the tokens, unit length, in DataFrame expressions: the same in every run."""

    def __init__(self, dim: int = 64):
        if not 1 <= dim <= 200:
            raise ValueError("dim: 1 to 200")
        self.dim = dim

    def documents(self, text: Column) -> Column:
        """Each token is one letter, by its place, in a string for either sign; a place's sum is how often its letter stands there."""
        let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
        letter = lambda i: F.char(i + 48)
        place = lambda h: F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(self.dim))
        spelt = lambda hs: F.array_join(F.transform(hs, lambda h: letter(place(h))), "")
        low = lambda h: F.substring(h, 9, 1) < "8"
        often = lambda s, i: F.length(s) - F.length(F.replace(s, letter(i), F.lit("")))
        summed = lambda both: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.dim - 1).cast("long")), lambda i: (often(both["plus"], i) - often(both["minus"], i)).cast("double"))
        signs = lambda hs: F.struct(spelt(F.filter(hs, low)).alias("plus"), spelt(F.filter(hs, lambda h: ~low(h))).alias("minus"))
        vector = let(let(F.transform(tokens(text), F.md5), signs), summed)
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        unit = lambda v: let(norm(v), lambda n: F.transform(v, lambda x: (x / F.greatest(n, F.lit(1e-12))).cast("float")))
        return let(vector, unit)

    def queries(self, text: Column) -> Column:
        return self.documents(text)


class ModelEmbedder:
    """A sentence model in Arrow batches; questions get the instruction the model was trained with."""

    #: Fixed value: the instruction before questions.
    INSTRUCTION = "Represent this sentence for searching relevant passages: "

    def __init__(self, name: str, dim: int = 768, batch: int = 64):
        self.name, self.dim, self.batch = name, dim, batch

    def _udf(self):
        name, batch = self.name, self.batch

        @F.pandas_udf("array<float>")
        def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(name)
            for t in texts:
                yield pd.Series(list(np.asarray(model.encode(t.tolist(), batch_size=batch, normalize_embeddings=True), np.float32)))

        return embed

    def documents(self, text: Column) -> Column:
        return self._udf()(text)

    def queries(self, text: Column) -> Column:
        return self._udf()(F.concat(F.lit(self.INSTRUCTION), text))


SYSTEM = "Read the service-manual passages and list the specifications that answer the question. Reply with JSON only; use confidence 0 if the passages do not state the value."
SHAPE = '{"specs": [{"component": "...", "spec_type": "Torque|Dimension|Alignment|Other", "value": "...", "unit": "..."}], "confidence": 0.0, "reasoning": "..."}'


def prompts(chunks: DataFrame) -> DataFrame:
    """(query_id, prompt) from (query_id, query, place, section_name, display_text): passages numbered in order."""
    passage = F.struct("place", F.concat(F.lit("Section: "), F.col("section_name"), F.lit("\n"), F.col("display_text")).alias("t"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(passage)), lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["t"])), "\n\n")
    rows = chunks.groupBy("query_id", "query").agg(listed.alias("context"))
    return rows.select("query_id", F.concat_ws("\n\n", F.lit(SYSTEM), F.lit("Answer in this shape: " + SHAPE), F.concat(F.lit("Passages:\n"), "context"), F.concat(F.lit("Question: "), "query")).alias("prompt"))


class Extractor(Protocol):
    def online(self) -> bool: ...

    def generate(self, prompt: str) -> str: ...


class HttpExtractor:
    """A model server with a tag list and a generate call; probes take 4 s, answers 60 s at most."""

    def __init__(self, host: str = "http://localhost:11434", model: str = "llama3.1:8b", timeout: float = 60.0):
        self.host, self.model, self.timeout = host.rstrip("/"), model, timeout

    def online(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.host}/api/tags", timeout=4) as r:
                return any(m.get("name", "").split(":")[0] == self.model.split(":")[0] for m in json.load(r).get("models", []))
        except OSError:
            return False

    def generate(self, prompt: str) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": 0, "num_predict": 600, "top_p": 0.9}}
        request = urllib.request.Request(f"{self.host}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.load(r).get("response", "")


def respond(asked: DataFrame, extractor: Extractor) -> DataFrame:
    """(query_id, response): one call for each prompt, in the partitions' tasks; a failed call is an empty response."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for prompt in b["prompt"]:
                try:
                    out.append(extractor.generate(prompt))
                except OSError:
                    out.append("")
            yield pd.DataFrame({"query_id": b["query_id"], "response": out})

    kind = dict(asked.dtypes)["query_id"]
    return asked.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, response string")
