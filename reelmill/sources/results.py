"""Results of runs as files a sequence, published as a whole or left as partial files.

A task writes the files of its sequences under hidden names and says so in a small list
beside them; the driver gets the list's name. When all tasks are through, the files are
renamed to their final names, the manifest last; a job that fails renames them to
partial ones. A reader sees a sequence whole or not at all.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from reelmill.operators.evaluation import KEY

FORMAT = "frame_results"
SCHEMA = "dataset string, sequence string, frame_id int, box array<double>, time double, record string, expected_frames int"
#: Each file's name behind its sequence's, when it is final and when it is partial; the manifest comes last.
NAMES = {"box": (".txt", ".partial.txt"), "time": ("_time.txt", "_time.partial.txt"), "frames": ("_frames.jsonl", "_frames.partial.jsonl"), "manifest": ("_manifest.json", "_manifest.partial.json")}


def box_line(box: list[float] | None) -> str:
    """Four numbers with six places, or four nan where the target can't be located."""
    if box is not None and len(box) != 4:
        raise ValueError(f"a box has four numbers, not {len(box)}")
    if box is None or not all(x is not None and math.isfinite(x) for x in box):
        return "nan\tnan\tnan\tnan\n"
    return "\t".join(f"{x:.6f}" for x in box) + "\n"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class _Folder:
    """The folder of results, in any store that the driver and the executors share."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(path)

    def at(self, dataset: str, name: str) -> str:
        return f"{self.path}/{dataset}/{name}"

    def there(self, path: str) -> bool:
        return self.fs.get_file_info(path).type == fs.FileType.File

    def read(self, path: str) -> str:
        with self.fs.open_input_stream(path) as f:
            return f.read().decode()

    def write(self, path: str, text: str) -> None:
        with self.fs.open_output_stream(path) as f:
            f.write(text.encode())

    def publish(self, item: dict) -> None:
        """Renames a sequence's hidden files: final names if it is complete, partial ones if not."""
        final = 0 if item["completed"] else 1
        for kind, names in NAMES.items():
            hidden = self.at(item["dataset"], f".{item['sequence']}.{kind}.{item['token']}")
            if self.there(hidden):
                self.fs.move(hidden, self.at(item["dataset"], item["sequence"] + names[final]))
            if item["completed"] and self.there(old := self.at(item["dataset"], item["sequence"] + names[1])):
                self.fs.delete_file(old)


class _Sequence:
    """The open files of one sequence."""

    def __init__(self, folder: _Folder, row: Row, token: str, options: dict, overwrite: bool) -> None:
        self.folder, self.token, self.options, self.began, self.n = folder, token, options, _now(), 0
        self.dataset, self.name, self.expected = row.dataset, row.sequence, row.expected_frames
        if not overwrite and any(folder.there(folder.at(self.dataset, self.name + final)) for final, _ in NAMES.values()):
            raise FileExistsError(f"{self.dataset}/{self.name} has results already")
        folder.fs.create_dir(f"{folder.path}/{self.dataset}", recursive=True)
        self.open = {kind: folder.fs.open_output_stream(self._hidden(kind)) for kind in ("box", "time", "frames")}

    def _hidden(self, kind: str) -> str:
        return self.folder.at(self.dataset, f".{self.name}.{kind}.{self.token}")

    def add(self, row: Row) -> None:
        if row.frame_id != self.n:
            raise ValueError(f"frames of {self.dataset}/{self.name} must follow one another: {self.n} was due, not {row.frame_id}")
        for kind, text in (("box", box_line(row.box)), ("time", f"{float(row.time):.9f}\n"), ("frames", row.record + "\n")):
            self.open[kind].write(text.encode())
        self.n += 1

    def close(self, error: BaseException | None = None) -> dict:
        for f in self.open.values():
            f.close()
        done = error is None and self.n == self.expected
        manifest = {
            "tracker": self.options.get("tracker"), "parameter": self.options.get("parameter"), "dataset": self.dataset, "sequence": self.name,
            "expected_frames": self.expected, "frames_written": self.n, "completed": done, "started_at": self.began, "finished_at": _now(),
            "error": error and {"type": type(error).__name__, "message": str(error)}, "extra": json.loads(self.options.get("extra") or "{}"),
        }
        self.folder.write(self._hidden("manifest"), json.dumps(manifest, ensure_ascii=False, indent=2, allow_nan=False) + "\n")
        return {"dataset": self.dataset, "sequence": self.name, "token": self.token, "completed": done}


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: its list's name, and how many sequences it wrote."""

    listing: str
    sequences: int


class ResultWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite = dict(options), overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, token, now = _Folder(self.options["path"]), uuid.uuid4().hex, None
        folder.fs.create_dir(folder.path, recursive=True)
        listing, n = f"{folder.path}/.tasks.{token}", 0
        try:
            with folder.fs.open_output_stream(listing) as done:
                for row in iterator:
                    if now is None or (now.dataset, now.name) != (row.dataset, row.sequence):
                        if now is not None:
                            done.write((json.dumps(now.close()) + "\n").encode())
                            now, n = None, n + 1
                        now = _Sequence(folder, row, token, self.options, self.overwrite)
                    now.add(row)
                if now is not None:
                    done.write((json.dumps(now.close()) + "\n").encode())
                    n += 1
        except BaseException as error:
            # what this attempt has written stays as partial files, whatever becomes of the job
            if now is not None:
                folder.publish(now.close(error) | {"completed": False})
            self._each(folder, listing, completed=False)
            folder.fs.delete_file(listing)
            raise
        return Written(listing, n)

    @staticmethod
    def _each(folder: _Folder, listing: str, **change) -> None:
        for line in folder.read(listing).splitlines():
            folder.publish(json.loads(line) | change)

    def commit(self, messages: list) -> None:
        self._finish(messages)

    def abort(self, messages: list) -> None:
        self._finish(messages, completed=False)

    def _finish(self, messages: list, **change) -> None:
        folder = _Folder(self.options["path"])
        for m in messages:
            if m is not None and folder.there(m.listing):
                self._each(folder, m.listing, **change)
                folder.fs.delete_file(m.listing)


class FrameResults(DataSource):
    """Rows of SCHEMA, a task's sorted by sequence and frame, as files a sequence."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ResultWriter:
        return ResultWriter(self.options, overwrite)


def write_results(rows: DataFrame, path: str, tracker: str = "", parameter: str = "", extra: str = "{}", overwrite: bool = False) -> None:
    """Writes rows (SCHEMA) below path: for each sequence its boxes, times, records and a manifest.

    A sequence's frames must be 0, 1, 2, and so on; one with fewer than expected_frames
    gives partial files and a manifest that says so. Results that are there already are
    an error unless overwrite. If the job fails, partial files are all that is left of it.
    """
    rows.sparkSession.dataSource.register(FrameResults)
    dealt = rows.select(*KEY, "frame_id", F.col("box").cast("array<double>"), F.col("time").cast("double"), "record", F.col("expected_frames").cast("int")).repartition(*KEY).sortWithinPartitions(*KEY, "frame_id")
    options = {"tracker": tracker, "parameter": parameter, "extra": extra}
    dealt.write.format(FORMAT).options(**options).mode("overwrite" if overwrite else "append").save(path)
