"""Settings: defaults, then a YAML file, then environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

LEVELS = ("debug", "info", "warn", "error")
PREFIX = "TARN_"


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    """Directories follow the vault unless they are set themselves."""

    vault: str
    templates: str
    schemas: str
    properties: str
    cache: str
    log_level: str = "info"

    @classmethod
    def of(cls, vault: str, **given: str) -> Settings:
        below = lambda name, default: resolve(given[name], vault) if given.get(name) else os.path.join(vault, default)
        schemas = below("schemas", "schemas")
        return cls(vault, below("templates", "templates"), schemas, resolve(given["properties"], vault) if given.get("properties") else os.path.join(schemas, "properties"), below("cache", ".cache"), given.get("log_level") or "info")

    def check(self) -> None:
        if not os.path.exists(self.vault):
            raise SettingsError(f"vault '{self.vault}' does not exist")
        if not os.path.isdir(self.vault):
            raise SettingsError(f"vault '{self.vault}' is not a directory")
        if not os.access(self.vault, os.R_OK):
            raise SettingsError(f"vault '{self.vault}' can't be read")
        if self.log_level.lower() not in LEVELS:
            raise SettingsError(f"log level '{self.log_level}' is none of {', '.join(LEVELS)}")


def resolve(path: str, base: str) -> str:
    return path if os.path.isabs(path) else os.path.join(base, path)


#: Keys of the YAML file and the setting that each one fills.
KEYS = {"vaultPath": "vault", "templatesDir": "templates", "schemasDir": "schemas", "propertiesDir": "properties", "cacheDir": "cache", "logLevel": "log_level"}


def load(directories: list[str] | None = None, environment: Mapping[str, str] | None = None, name: str = "tarn.yaml") -> Settings:
    """Settings of the first file found in the directories (the working directory, then home), overridden by ``TARN_VAULT`` and the like."""
    import yaml

    given: dict[str, str] = {}
    for directory in directories if directories is not None else [".", os.path.expanduser("~")]:
        path = os.path.join(directory, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as file:
                data = yaml.safe_load(file) or {}
            given |= {KEYS[k]: str(v) for k, v in data.items() if k in KEYS}
            break
    environment = os.environ if environment is None else environment
    for key in KEYS.values():
        if environment.get(PREFIX + key.upper()):
            given[key] = environment[PREFIX + key.upper()]
    vault = given.pop("vault", None) or os.getcwd()
    return Settings.of(vault, **given)
