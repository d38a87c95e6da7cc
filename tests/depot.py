"""An Arrow file system over a local folder that counts the bytes read, for the tests' own scheme ``depot:``."""

from pyarrow.fs import FileSelector, FileSystemHandler, LocalFileSystem, PyFileSystem

READ = [0]


class Counted:
    def __init__(self, f):
        self.f = f

    def read(self, n=-1):
        data = self.f.read(n)
        READ[0] += len(data)
        return data

    def __getattr__(self, name):
        return getattr(self.f, name)


class Depot(FileSystemHandler):
    fs = LocalFileSystem()

    def get_type_name(self):
        return "depot"

    def normalize_path(self, path):
        return path

    def get_file_info(self, paths):
        return self.fs.get_file_info(paths)

    def get_file_info_selector(self, selector):
        return self.fs.get_file_info(FileSelector(selector.base_dir, allow_not_found=selector.allow_not_found, recursive=selector.recursive))

    def open_input_file(self, path):
        import pyarrow as pa

        return pa.PythonFile(Counted(open(path, "rb")), mode="r")

    def _refused(self, *_, **__):
        raise NotImplementedError

    open_input_stream = open_output_stream = open_append_stream = create_dir = delete_dir = delete_dir_contents = delete_root_dir_contents = delete_file = move = copy_file = _refused


def open_depot(uri):
    return PyFileSystem(Depot()), uri.removeprefix("depot:")
