"""A store behind a handler of its own: local files that are reached only through Arrow's file-system interface."""

import pyarrow as pa
from pyarrow import fs


class Handler(fs.FileSystemHandler):
    def __init__(self):
        self.inner = fs.LocalFileSystem()

    def get_type_name(self):
        return "far"

    def normalize_path(self, path):
        return path

    def get_file_info(self, paths):
        return self.inner.get_file_info(paths)

    def get_file_info_selector(self, selector):
        return self.inner.get_file_info(selector)

    def create_dir(self, path, recursive):
        self.inner.create_dir(path, recursive=recursive)

    def delete_dir(self, path):
        self.inner.delete_dir(path)

    def delete_dir_contents(self, path, missing_dir_ok=False):
        self.inner.delete_dir_contents(path, missing_dir_ok=missing_dir_ok)

    def delete_root_dir_contents(self):
        raise NotImplementedError

    def delete_file(self, path):
        self.inner.delete_file(path)

    def move(self, src, dest):
        self.inner.move(src, dest)

    def copy_file(self, src, dest):
        self.inner.copy_file(src, dest)

    def open_input_stream(self, path):
        return pa.PythonFile(open(path, "rb"), mode="r")

    def open_input_file(self, path):
        return pa.PythonFile(open(path, "rb"), mode="r")

    def open_output_stream(self, path, metadata):
        return pa.PythonFile(open(path, "wb"), mode="w")

    def open_append_stream(self, path, metadata):
        return pa.PythonFile(open(path, "ab"), mode="w")


def opened():
    return fs.PyFileSystem(Handler())
