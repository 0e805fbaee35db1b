"""Feather (Arrow IPC file) folders as a Spark data source.

Large files are read by several tasks, a run of record batches each; small files share a task. Option "columns" (names
with commas) leaves out all other columns. Option "equals" (a JSON object of column and value) keeps rows that have
these values: `stem` leaves out whole files, others are tried on their columns alone before the rest of a batch is read.
These are options and no pushed filters, as Spark keeps what was pushed into a Python source for every later use of the
same DataFrame.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Bytes of files that a task reads; larger files are cut between their record batches.
TASK_BYTES = 32 << 20


def register_feather(spark: SparkSession) -> None:
    """Make format("feather") known to the session. Reads add `stem`, the file name without its ending."""
    spark.dataSource.register(_source(TASK_BYTES))


def _source(task_bytes):
    # Defined here and not at module level, so that tasks get the classes by value and need no package installed.
    from dataclasses import dataclass

    from pyspark.sql.datasource import (
        DataSource,
        DataSourceArrowWriter,
        DataSourceReader,
        InputPartition,
        WriterCommitMessage,
    )

    def open_fs(path):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def files(path):
        from pyarrow import fs

        system, root = open_fs(path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root))
        found = [f for f in found if f.is_file and f.base_name.endswith(".feather")]
        return system, sorted(found, key=lambda f: f.path)

    @dataclass
    class Pieces(InputPartition):
        """(file, first batch, batch after the last one or None for all)."""

        pieces: list[tuple[str, int, int | None]]

    def stem_of(path):
        return path.rsplit("/", 1)[-1].removesuffix(".feather")

    def keep(table, equals):
        """Which rows have all values; NULL has none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        mask = pa.chunked_array([pa.array([True] * len(table))])
        for name, value in equals.items():
            mask = pc.and_(mask, pc.fill_null(pc.equal(table.column(name), pa.scalar(value)), False))
        return mask

    class Reader(DataSourceReader):
        def __init__(self, path, schema, equals):
            self.path, self.schema, self.equals = path, schema, equals

        def partitions(self):
            import pyarrow as pa

            # Only large files are opened here, to learn how many batches they hold.
            system, found = files(self.path)
            held, size, out = [], 0, []
            for info in found:
                if "stem" in self.equals and stem_of(info.path) != self.equals["stem"]:
                    continue
                if info.size > task_bytes:
                    with system.open_input_file(info.path) as handle:
                        batches = pa.ipc.open_file(handle).num_record_batches
                    parts = min(batches, -(-info.size // task_bytes)) or 1
                    cuts = [batches * k // parts for k in range(parts + 1)]
                    out += [Pieces([(info.path, a, b)]) for a, b in zip(cuts, cuts[1:])]
                    continue
                if held and size + info.size > task_bytes:
                    out.append(Pieces(held))
                    held, size = [], 0
                held.append((info.path, 0, None))
                size += info.size
            return out + ([Pieces(held)] if held else [])

        def read(self, partition):
            for path, first, last in partition.pieces:
                yield from self._batches(path, first, last)

        def _batches(self, path, first, last):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            target = to_arrow_schema(self.schema)
            system, _ = open_fs(self.path)

            def only(handle, names):
                at = [i for i, n in enumerate(present) if n in names]
                return pa.ipc.open_file(handle, options=pa.ipc.IpcReadOptions(included_fields=at)) if at else None

            def told(content, i, names):
                table = pa.Table.from_batches([content.get_batch(i)])
                if "stem" in names and "stem" not in present:
                    table = table.append_column("stem", pa.array([stem_of(path)] * len(table), pa.string()))
                return table

            with system.open_input_file(path) as handle:
                whole = pa.ipc.open_file(handle)
                present = whole.schema.names
                asked = set(self.equals)
                content = only(handle, target.names) or whole
                tested = only(handle, asked) if asked else None
                for i in range(first, whole.num_record_batches if last is None else last):
                    mask = keep(told(tested, i, asked), self.equals) if tested else None
                    if mask is not None and not any(mask.to_pylist()):
                        continue
                    table = told(content, i, target.names)
                    table = table if mask is None else table.filter(mask)
                    yield from table.select(target.names).cast(target).to_batches()

    @dataclass
    class Written(WriterCommitMessage):
        name: str

    class Writer(DataSourceArrowWriter):
        """Tasks write under a staging folder of the job; only files of committed tasks are moved into place."""

        def __init__(self, path, overwrite):
            import uuid

            self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

        def _staging(self, root):
            return f"{root}/_staging-{self.job}"

        def write(self, iterator):
            import uuid

            import pyarrow as pa

            system, root = open_fs(self.path)
            system.create_dir(self._staging(root), recursive=True)
            name, out, writer = f"part-{uuid.uuid4().hex}.feather", None, None
            for batch in iterator:
                if writer is None:
                    out = system.open_output_stream(f"{self._staging(root)}/{name}")
                    writer = pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                writer.write_batch(batch)
            if writer is None:
                return Written("")
            writer.close()
            out.close()
            return Written(name)

        def commit(self, messages):
            system, root = open_fs(self.path)
            old = files(self.path)[1] if self.overwrite else []
            for m in messages:
                if m is not None and m.name:
                    system.move(f"{self._staging(root)}/{m.name}", f"{root}/{m.name}")
            for f in old:
                system.delete_file(f.path)
            self.abort(messages)

        def abort(self, messages):
            from pyarrow import fs

            system, root = open_fs(self.path)
            if system.get_file_info(self._staging(root)).type == fs.FileType.Directory:
                system.delete_dir(self._staging(root))

    class Feather(DataSource):
        @classmethod
        def name(cls):
            return "feather"

        def schema(self):
            import pyarrow as pa
            from pyspark.sql.pandas.types import from_arrow_schema
            from pyspark.sql.types import StringType, StructType

            system, found = files(self.options["path"])
            if not found:
                raise FileNotFoundError(self.options["path"])
            with system.open_input_file(found[0].path) as handle:
                schema = from_arrow_schema(pa.ipc.open_file(handle).schema)
            schema = schema if "stem" in schema.names else schema.add("stem", StringType())
            asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
            return StructType([schema[c] for c in asked]) if asked else schema

        def reader(self, schema):
            import json

            return Reader(self.options["path"], schema, json.loads(self.options.get("equals", "{}")))

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], overwrite)

    return Feather
