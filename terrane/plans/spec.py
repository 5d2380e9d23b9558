"""Specifications: named, versioned, fingerprinted descriptions of plans, and the registry that builds them."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any


def canonical(value: Any) -> str:
    """JSON that is equal for equal values: sorted keys, no blanks, tuples as lists."""
    plain = lambda x: x.item() if hasattr(x, "item") else str(x)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=plain)


@dataclass(frozen=True)
class Spec:
    name: str
    params: Mapping[str, Any] = field(default_factory=dict)
    version: int = 1

    def to_dict(self) -> dict:
        return {"name": self.name, "params": dict(self.params), "version": self.version}

    @classmethod
    def from_dict(cls, value: Mapping) -> Spec:
        if unknown := set(value) - {"name", "params", "version"}:
            raise ValueError(f"unknown keys in a specification: {sorted(unknown)}")
        return cls(value["name"], dict(value.get("params", {})), value.get("version", 1))

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(canonical(self.to_dict()).encode()).hexdigest()


class Registry:
    """Builders by name within a domain."""

    def __init__(self, domain: str):
        self.domain = domain
        self._builders: dict[str, Callable] = {}

    def add(self, name: str) -> Callable[[Callable], Callable]:
        def keep(builder: Callable) -> Callable:
            if name in self._builders:
                raise ValueError(f"{self.domain} {name} is registered twice")
            self._builders[name] = builder
            return builder

        return keep

    def names(self) -> list[str]:
        return sorted(self._builders)

    def build(self, spec: Spec, **context: Any) -> Any:
        if spec.name not in self._builders:
            raise ValueError(f"no {self.domain} named {spec.name}; there are {self.names()}")
        return self._builders[spec.name](**context, **spec.params)

    def load_plugins(self, group: str = "terrane.plugins") -> list[str]:
        """Call the entry points of a group with this registry; returns their names."""
        from importlib.metadata import entry_points

        found = entry_points(group=group)
        for point in found:
            point.load()(self)
        return [p.name for p in found]


def parse_features(text: str) -> Spec:
    """The specification of a feature expression such as ``concat(raw("T1"), ratio(raw("T1"), raw("T2")))``.

    Calls are components; quoted names are modalities; ``key=value`` are parameters.
    In a call with calls inside, quoted names stand for ``raw`` components, and a list
    of weights is keyed by each child's alias, modality or name.
    """
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"not a feature expression: {text}") from error

    def build(node: ast.AST) -> Spec:
        if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Name)):
            raise ValueError(f"a component is wanted, not {ast.unparse(node)}")
        params: dict[str, Any] = {}
        for keyword in node.keywords:
            if keyword.arg is None:
                raise ValueError("** is not allowed")
            params[keyword.arg] = ast.literal_eval(keyword.value)
        nested = any(isinstance(a, ast.Call) for a in node.args)
        children, names = [], []
        for arg in node.args:
            if isinstance(arg, ast.Call):
                child = build(arg)
                children.append({"name": child.name, "params": dict(child.params)})
            elif isinstance(arg, ast.Constant) and isinstance(arg.value, str):
                children.append({"name": "raw", "params": {"modality": arg.value}})
                names.append(arg.value)
            else:
                raise ValueError(f"not allowed in a feature expression: {ast.unparse(arg)}")
        if nested:
            weights = params.get("weights")
            if isinstance(weights, list):
                if len(weights) != len(children):
                    raise ValueError("as many weights as children are wanted")
                label = lambda c: c["params"].get("as_") or c["params"].get("modality") or c["name"]
                params["weights"] = {label(c): w for c, w in zip(children, weights, strict=True)}
            params["children"] = children
        elif len(names) == 1:
            params["modality"] = names[0]
        elif names:
            params["modalities"] = names
        return Spec(node.func.id, params)

    return build(tree)
