"""Closed vocabularies and fixed lists. All values here are fixed values of the data model."""

from __future__ import annotations

# Component kinds.
KINDS = (
    "rust-library", "rust-cli", "rust-proc-macro", "workspace", "node-library", "node-cli", "react-app", "react-library",
    "python-library", "python-app", "dart-library", "dart-app", "flutter-app", "dotnet-library", "dotnet-service",
    "website", "service", "docker-image", "docker-compose-bundle", "installer", "shell-scripts", "sql-scripts",
    "codegen-tool", "config-repo", "docs-repo", "spec", "external", "non-component",
)

# Lifecycle scopes and evidence grades.
LIFECYCLES = ("design", "codegen", "build", "test", "deploy", "runtime", "dev-workflow")
GRADES = ("strong", "medium", "weak")

# Edge kinds; the symmetric ones have no direction.
EDGE_KINDS = (
    "communicates-with", "calls", "generates", "scaffolds", "invokes", "orchestrates", "depends-on", "links-statically",
    "links-dynamically", "has-optional-dependency", "provided-by-host", "embeds", "co-implements", "conforms-to",
    "describes", "tests", "provides-fixtures-for",
)
SYMMETRIC_KINDS = ("communicates-with", "co-implements")

# Manifest file names; any name that ends in MANIFEST_SUFFIX counts too.
MANIFESTS = (
    "Cargo.toml", "package.json", "pyproject.toml", "go.mod", "setup.py", "Gemfile", "pom.xml", "build.gradle",
    "CMakeLists.txt", "Dockerfile", "flake.nix", "shard.yml", "mix.exs", "composer.json", "deno.json",
)
MANIFEST_SUFFIX = ".nix"

# Names, without extension and in capitals, of files whose headings describe a directory.
README_STEMS = ("README", "CHANGELOG", "CONTRIBUTING")

# Kinds that are often written otherwise.
KIND_SUGGESTIONS = {
    "rust-binary": "rust-cli",
    "node-package": "node-library",
    "python-package": "python-library",
    "dart-package": "dart-library",
    "typescript-library": "node-library",
    "wix-installer": "installer",
    "msi-installer": "installer",
    "deb-package": "installer",
    "dmg": "installer",
    "shell-script": "shell-scripts",
    "sql-script": "sql-scripts",
    "python-cli": "python-app",
    "python-service": "service",
    "node-service": "service",
    "python-codegen-tool": "codegen-tool",
    "rust-codegen-tool": "codegen-tool",
    "node-codegen-tool": "codegen-tool",
}

# What sub-carving does with each kind when depth allows; libraries are undecided by kind alone.
RECURSE_KINDS = ("workspace",)
LIBRARY_KINDS = ("rust-library", "node-library", "python-library", "dart-library", "dotnet-library", "react-library")
LIBRARY_DEPTH_CAP = 3

# Fields that a pin may set.
PIN_FIELDS = ("kind", "language", "build_system", "role", "suppress", "suppress_children")

# What a surface may say about a component's part in an interaction.
ROLE_HINTS = ("generator", "orchestrator", "test-harness", "spec-document", "spawner", "documented-by", "client", "server", "library", "tool")
