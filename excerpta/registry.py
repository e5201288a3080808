"""Named libraries under one application root."""

from __future__ import annotations

import re
import uuid

from excerpta.errors import LibraryRegistryError
from excerpta.functions.identity import ID_PATTERNS
from excerpta.library import Library
from excerpta.storage import Folder

REGISTRY = "libraries.json"
MAX_NAME_CHARS = 120
MAX_DESCRIPTION_CHARS = 2000


def _text(value, label, maximum, required):
    if type(value) is not str:
        raise LibraryRegistryError(f"{label} must be text")
    value = value.strip()
    if required and not value or len(value) > maximum or "\0" in value:
        raise LibraryRegistryError(f"{label} must have at most {maximum} characters")
    return value


class LibraryRegistry:
    def __init__(self, spark, root):
        self.spark = spark
        self.folder = Folder(spark, root)

    def _load(self):
        if not self.folder.exists(REGISTRY):
            return {"version": 1, "selected_library_id": None, "libraries": []}
        state = self.folder.read_json(REGISTRY)
        ids = [record["library_id"] for record in state["libraries"]]
        selected = state["selected_library_id"]
        if len(set(ids)) != len(ids) or (selected not in ids if ids else selected is not None):
            raise LibraryRegistryError("the registry is inconsistent")
        return state

    def _find(self, state, library_id):
        if type(library_id) is not str or not re.match(ID_PATTERNS["library_id"], library_id):
            raise LibraryRegistryError("library_id is malformed")
        for record in state["libraries"]:
            if record["library_id"] == library_id:
                return record
        raise LibraryRegistryError("library_id is not registered")

    def _public(self, state, record):
        return {**record, "selected": record["library_id"] == state["selected_library_id"]}

    def list_libraries(self):
        state = self._load()
        return [self._public(state, record) for record in state["libraries"]]

    def overview(self):
        """Every library with its snapshot count and pointers."""
        return [{**item, **self.library(item["library_id"]).catalog_status()} for item in self.list_libraries()]

    def create(self, name, description=""):
        name = _text(name, "name", MAX_NAME_CHARS, True)
        description = _text(description, "description", MAX_DESCRIPTION_CHARS, False)
        state = self._load()
        record = {"library_id": f"lib_{uuid.uuid4().hex}", "name": name, "description": description}
        state["libraries"].append(record)
        state["selected_library_id"] = state["selected_library_id"] or record["library_id"]
        self.folder.write_json(state, REGISTRY)
        return self._public(state, record)

    def _change(self, library_id, **values):
        state = self._load()
        record = self._find(state, library_id)
        record.update(values)
        self.folder.write_json(state, REGISTRY)
        return self._public(state, record)

    def rename(self, library_id, name):
        return self._change(library_id, name=_text(name, "name", MAX_NAME_CHARS, True))

    def update_description(self, library_id, description):
        return self._change(library_id, description=_text(description, "description", MAX_DESCRIPTION_CHARS, False))

    def select(self, library_id):
        state = self._load()
        record = self._find(state, library_id)
        state["selected_library_id"] = library_id
        self.folder.write_json(state, REGISTRY)
        return self._public(state, record)

    def delete(self, library_id, confirmation_name):
        """Unregister first, then remove the files; the selection falls to the first that remains."""
        state = self._load()
        record = self._find(state, library_id)
        if confirmation_name != record["name"]:
            raise LibraryRegistryError("the confirmation is not the library's exact name")
        state["libraries"].remove(record)
        if state["selected_library_id"] == library_id:
            state["selected_library_id"] = state["libraries"][0]["library_id"] if state["libraries"] else None
        self.folder.write_json(state, REGISTRY)
        self.folder.remove("libraries", library_id)
        return {"deleted_library_id": library_id, "deleted": True, "selected_library_id": state["selected_library_id"]}

    def library_path(self, library_id):
        self._find(self._load(), library_id)
        return self.folder.path("libraries", library_id)

    def selected_library_path(self):
        selected = self._load()["selected_library_id"]
        if selected is None:
            raise LibraryRegistryError("no library is selected")
        return self.library_path(selected)

    def library(self, library_id, **options):
        return Library(self.spark, self.library_path(library_id), library_id=library_id, **options)
