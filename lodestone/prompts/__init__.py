"""The prompts that come with the package: one Markdown template for each prompt of the pipeline."""

from __future__ import annotations

import os
from importlib.resources import files

from ..respond.core import PROMPTS, template_sha
from ..respond.templates import coverage

#: What the pipeline fills into each prompt, and inputs that only tell one cached answer from another.
INPUTS = {
    "classify": ({"DIR_RELATIVE", "RATIONALE_BUNDLE"}, set()),
    "surface": ({"COMPONENT_ID", "COMPONENT_KIND", "PATH_SEGMENTS", "CONTENT_SHAS"}, {"CONTENT_SHAS"}),
    "edges": ({"SURFACE_RECORDS"}, set()),
    "subcarve": ({"COMPONENT_ID", "COMPONENT_KIND", "SUB_DIRS"}, set()),
}


def template(name: str) -> str:
    """The template of one prompt; an unknown name is an error."""
    if name not in PROMPTS:
        raise KeyError(f"no prompt {name}")
    return files(__package__).joinpath(f"{name}.md").read_text(encoding="utf-8")


def packaged_sha() -> str:
    """Digest of all templates, for the fingerprint under which answers are kept."""
    return template_sha((n, template(n)) for n in PROMPTS)


def write_to(folder: str) -> list[str]:
    """Write all templates to a folder that exists; their paths."""
    out = []
    for n in PROMPTS:
        out.append(os.path.join(folder, f"{n}.md"))
        with open(out[-1], "w", encoding="utf-8") as f:
            f.write(template(n))
    return out


def problems() -> list[str]:
    """Names that a template asks for and nobody fills, and inputs that no template uses."""
    out = []
    for n in PROMPTS:
        missing, unused = coverage(template(n), *INPUTS[n])
        out += [f"{n}: nothing fills {x}" for x in sorted(missing)] + [f"{n}: {x} is not used" for x in sorted(unused)]
    return out
