"""A stand-in for h5py in tests: a file is a pickled tree of groups, attributes and arrays."""

import pickle


class Group(dict):
    def create_group(self, name):
        return self.setdefault(name, Group())

    def create_dataset(self, name, data):
        self[name] = data


class File(Group):
    def __init__(self, path, mode="r"):
        super().__init__()
        self.path, self.mode, self.attrs = path, mode, {}
        if mode == "r":
            with open(path, "rb") as file:
                tree, self.attrs = pickle.load(file)
            self.update(tree)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.mode == "w":
            with open(self.path, "wb") as file:
                pickle.dump(({k: dict(v) for k, v in self.items()}, self.attrs), file)
