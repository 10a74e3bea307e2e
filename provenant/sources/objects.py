"""Files of an object store through Spark's own file system layer, and parsers of documents behind a boundary."""

from __future__ import annotations

import json
import os
import subprocess
import time
import urllib.request
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from . import content


class Objects:
    """Objects below ``root``, which may be on any file system that Spark reads; ``sign`` makes links (key, seconds), as only the store's own client can."""

    def __init__(self, spark: SparkSession, root: str, sign: Callable[[str, int], str] | None = None):
        self.spark, self.root, self.sign = spark, root.rstrip("/"), sign

    @classmethod
    def from_env(cls, spark: SparkSession, env: Mapping[str, str] = os.environ) -> Objects:
        """The store that OBJECT_STORE_ROOT names; its folder is made if it is not there."""
        if not env.get("OBJECT_STORE_ROOT"):
            raise ValueError("OBJECT_STORE_ROOT is not set")
        store = cls(spark, env["OBJECT_STORE_ROOT"])
        fs, at = store._at("")
        fs.mkdirs(at)
        return store

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _at(self, key: str):
        at = self._path(f"{self.root}/{key}" if key else self.root)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def list(self, prefix: str = "") -> DataFrame:
        """Objects below a prefix: path, length and time."""
        return content.objects(self.spark, f"{self.root}/{prefix}".rstrip("/"))

    def exists(self, key: str) -> bool:
        """Whether an object is there."""
        fs, at = self._at(key)
        return fs.exists(at)

    def upload(self, local: str, key: str) -> None:
        """Copy a file, or a folder with all in it, into the store; what is there under the key is replaced."""
        fs, at = self._at(key)
        fs.delete(at, True)
        fs.copyFromLocalFile(False, True, self._path(f"file://{os.path.abspath(local)}"), at)

    def download(self, key: str, local: str) -> None:
        """Copy an object out of the store."""
        fs, at = self._at(key)
        if not fs.exists(at):
            raise FileNotFoundError(key)
        fs.copyToLocalFile(False, at, self._path(f"file://{os.path.abspath(local)}"), True)

    def delete(self, key: str) -> bool:
        """Delete an object, or all below a folder; whether there was one."""
        fs, at = self._at(key)
        return fs.delete(at, True)

    def link(self, key: str, seconds: int = 3600) -> str:
        """A link to an object that ends after some seconds."""
        if self.sign is None:
            raise ValueError("the store was opened without a way to sign links")
        return self.sign(key, seconds)


Parser = Callable[[bytes], str]


def content_list(said: str, name: str = "content_list") -> str:
    """The content list of a parser's JSON: the list itself, or the member ``name``, else the first member that is a list."""
    data = json.loads(said)
    if isinstance(data, dict):
        lists = [v for v in (data.get(name), *data.values()) if isinstance(v, list)]
        data = lists[0] if lists else None
    if not isinstance(data, list):
        raise ValueError("the parser gave no content list")
    return json.dumps(data, ensure_ascii=False)


def command_parser(*commands: list[str], timeout: float = 600) -> Parser:
    """A parser that runs the first command that there is: the document on its standard input, JSON on its standard output."""

    def parse(document: bytes) -> str:
        for command in commands:
            try:
                done = subprocess.run(command, input=document, capture_output=True, timeout=timeout, check=True)
            except FileNotFoundError:
                continue
            return content_list(done.stdout.decode())
        raise FileNotFoundError(f"none of the commands is there: {[c[0] for c in commands]}")

    return parse


def http_parser(url: str, headers: Mapping[str, str] | None = None, attempts: int = 3, pause: float = 1.0, timeout: float = 60, polls: int = 100, fetch: Callable[..., bytes] | None = None) -> Parser:
    """A parser behind HTTP: the document is posted; an answer with a poll_url is asked again until it has the list."""

    def get(at: str, body: bytes | None) -> bytes:
        request = urllib.request.Request(at, data=body, headers=dict(headers or {}))
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read()

    def tried(at: str, body: bytes | None) -> bytes:
        for n in range(attempts):
            try:
                return (fetch or get)(at, body)
            except OSError:
                if n == attempts - 1:
                    raise
                time.sleep(pause * 2**n)
        raise ValueError("attempts must be positive")

    def parse(document: bytes) -> str:
        said = tried(url, document).decode()
        for _ in range(polls):
            data = json.loads(said)
            if not (isinstance(data, dict) and "poll_url" in data):
                return content_list(said)
            time.sleep(pause)
            said = tried(data["poll_url"], None).decode()
        raise TimeoutError("the parser did not finish")

    return parse


def first_of(*parsers: Parser) -> Parser:
    """The first parser that succeeds; if none does, the last one's error."""

    def parse(document: bytes) -> str:
        for parser in parsers[:-1]:
            try:
                return parser(document)
            except Exception:  # whatever one parser raises, the next may do
                continue
        return parsers[-1](document)

    return parse
