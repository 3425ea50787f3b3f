"""Operator files on shared storage, opened by URI from Python workers.

Names carry a random part, so that a repeated task attempt never touches the
file of an earlier one; which files count is what the manifest says.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def _at(uri: str):
    return pafs.FileSystem.from_uri(uri)


def create(folder: str, partition: int, number: int, suffix: str):
    """(uri, binary output stream)"""
    store, path = _at(folder)
    store.create_dir(path, recursive=True)
    name = f"part-{partition:06d}-{number:04d}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)


def open_stream(uri: str):
    store, path = _at(uri)
    return store.open_input_stream(path, compression=None)


def open_random(uri: str):
    store, path = _at(uri)
    return store.open_input_file(path)
