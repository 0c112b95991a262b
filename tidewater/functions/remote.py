"""Functions of a row that need a tokenizer file or a web service: Arrow batches in pandas UDFs."""

from __future__ import annotations

import functools
import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

RETRIED = {408, 429, 500, 502, 503, 504}


@functools.lru_cache(maxsize=8)
def tokenizer(path: str):
    """A worker loads each tokenizer file once."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenize_encode(path: str, special: bool = True):
    """Texts to token ids; null for null. Executors read the file at that path."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def udf(texts: pd.Series) -> pd.Series:
        ids = iter(tokenizer(path).encode_batch(texts.dropna().tolist(), add_special_tokens=special))
        return pd.Series([next(ids).ids if known else None for known in texts.notna()], dtype=object)

    return udf


def tokenize_decode(path: str, skip_special: bool = True):
    @F.pandas_udf(StringType())
    def udf(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else tokenizer(path).decode([int(i) for i in x], skip_special_tokens=skip_special))

    return udf


def fetched(url: str, method: str, headers: dict, body: str | None, timeout: float, tries: int) -> str | None:
    """The answer's text; null for 404. Other errors raise, some after further tries."""
    for left in range(tries - 1, -1, -1):
        try:
            request = urllib.request.Request(url, data=body.encode() if body is not None else None, headers=headers, method=method)
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return r.read().decode()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code not in RETRIED or not left:
                raise
            time.sleep(0.2 * 2 ** (tries - 1 - left))
    return None


def http(method: str = "GET", headers: dict | None = None, timeout: float = 60, tries: int = 3):
    """One request for each row, but equal requests of a batch go out once; a null address gives null.

    The answer is the same for a row that is computed again only if the service's is.
    """
    headers = dict(headers or {})

    @F.pandas_udf(StringType())
    def udf(urls: pd.Series, bodies: pd.Series) -> pd.Series:
        @functools.cache
        def ask(url: str | None, body: str | None) -> str | None:
            return None if url is None else fetched(url, method, headers, body, timeout, tries)

        plain = lambda x: None if x is None or x != x else x
        return pd.Series([ask(plain(u), plain(b)) for u, b in zip(urls, bodies, strict=True)], dtype=object)

    return udf.asNondeterministic()
