"""Job options and the fixed tables of file policy.

The tables are fixed values: results must equal them entry by entry.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DiscoveryOptions:
    max_file_bytes: int = 1_000_000
    max_files: int = 20_000
    ignore_file_names: tuple[str, ...] = (".gitignore", ".indexignore")


@dataclass(frozen=True)
class ChunkOptions:
    max_tokens: int = 900
    min_tokens: int = 400
    overlap_lines: int = 6


@dataclass(frozen=True)
class Versions:
    chunker: str = "1"
    parser: str = "1"
    embedding: str = "none"


# Language by extension.
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript",
    "tsx": "typescript",
    "mts": "typescript",
    "cts": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "php": "php",
    "py": "python",
    "pyi": "python",
    "rb": "ruby",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "kt": "kotlin",
    "cs": "csharp",
    "swift": "swift",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "hpp": "cpp",
    "sh": "shell",
    "bash": "shell",
    "zsh": "shell",
    "ps1": "powershell",
    "sql": "sql",
    "graphql": "graphql",
    "gql": "graphql",
    "css": "css",
    "scss": "scss",
    "sass": "scss",
    "less": "less",
    "html": "html",
    "vue": "vue",
    "svelte": "svelte",
    "json": "json",
    "jsonc": "json",
    "yml": "yaml",
    "yaml": "yaml",
    "toml": "toml",
    "ini": "ini",
    "xml": "xml",
    "md": "markdown",
    "mdx": "markdown",
    "rst": "restructuredtext",
    "txt": "text",
}

# Language by exact name.
LANGUAGE_BY_NAME = {
    "Dockerfile": "dockerfile",
    "Makefile": "makefile",
    "Procfile": "text",
    ".env.example": "dotenv",
}

# Directories that are never walked, with category and message.
EXCLUDED_DIRECTORIES = {
    "node_modules": ("dependencies", "Installed dependency directory."),
    "vendor": ("dependencies", "Installed dependency directory."),
    "bower_components": ("dependencies", "Installed dependency directory."),
    ".git": ("vcs", "Version control metadata."),
    ".hg": ("vcs", "Version control metadata."),
    ".svn": ("vcs", "Version control metadata."),
    "dist": ("generated", "Build output directory."),
    "build": ("generated", "Build output directory."),
    "out": ("generated", "Build output directory."),
    ".next": ("generated", "Framework build output."),
    ".nuxt": ("generated", "Framework build output."),
    ".turbo": ("cache", "Task runner cache."),
    ".cache": ("cache", "Cache directory."),
    "__pycache__": ("cache", "Python bytecode cache."),
    ".pytest_cache": ("cache", "Test runner cache."),
    ".gradle": ("cache", "Build tool cache."),
    "coverage": ("generated", "Coverage report output."),
    ".venv": ("dependencies", "Python virtual environment."),
    "venv": ("dependencies", "Python virtual environment."),
    ".claude": ("tooling", "Agent tool metadata."),
    ".cursor": ("tooling", "Editor tool metadata."),
    ".idea": ("tooling", "Editor tool metadata."),
}

# Extensions that are no evidence, with category and message.
EXCLUDED_EXTENSIONS = {
    "png": ("media", "Image file."),
    "jpg": ("media", "Image file."),
    "jpeg": ("media", "Image file."),
    "gif": ("media", "Image file."),
    "webp": ("media", "Image file."),
    "avif": ("media", "Image file."),
    "bmp": ("media", "Image file."),
    "tiff": ("media", "Image file."),
    "ico": ("media", "Image file."),
    "icns": ("media", "Image file."),
    "svg": ("media", "Image file."),
    "mp4": ("media", "Audio or video file."),
    "mov": ("media", "Audio or video file."),
    "avi": ("media", "Audio or video file."),
    "mkv": ("media", "Audio or video file."),
    "webm": ("media", "Audio or video file."),
    "mp3": ("media", "Audio or video file."),
    "wav": ("media", "Audio or video file."),
    "flac": ("media", "Audio or video file."),
    "ogg": ("media", "Audio or video file."),
    "m4a": ("media", "Audio or video file."),
    "woff": ("media", "Font file."),
    "woff2": ("media", "Font file."),
    "ttf": ("media", "Font file."),
    "otf": ("media", "Font file."),
    "eot": ("media", "Font file."),
    "zip": ("binary", "Archive file."),
    "tar": ("binary", "Archive file."),
    "gz": ("binary", "Archive file."),
    "bz2": ("binary", "Archive file."),
    "xz": ("binary", "Archive file."),
    "7z": ("binary", "Archive file."),
    "rar": ("binary", "Archive file."),
    "exe": ("binary", "Compiled binary."),
    "dll": ("binary", "Compiled binary."),
    "so": ("binary", "Compiled binary."),
    "dylib": ("binary", "Compiled binary."),
    "bin": ("binary", "Compiled binary."),
    "o": ("binary", "Compiled binary."),
    "a": ("binary", "Compiled binary."),
    "class": ("binary", "Compiled binary."),
    "jar": ("binary", "Compiled binary."),
    "wasm": ("binary", "Compiled binary."),
    "node": ("binary", "Compiled binary."),
    "pdf": ("binary", "Binary document format."),
    "docx": ("binary", "Binary document format."),
    "xlsx": ("binary", "Binary document format."),
    "pptx": ("binary", "Binary document format."),
    "sqlite": ("binary", "Database file."),
    "sqlite3": ("binary", "Database file."),
    "db": ("binary", "Database file."),
    "mdb": ("binary", "Database file."),
    "pyc": ("generated", "Compiled Python bytecode."),
    "pyo": ("generated", "Compiled Python bytecode."),
    "lock": ("generated", "Dependency lockfile."),
    "map": ("generated", "Source map."),
    "pem": ("secret-bearing", "Key or certificate file."),
    "key": ("secret-bearing", "Key or certificate file."),
    "p12": ("secret-bearing", "Key or certificate file."),
    "pfx": ("secret-bearing", "Key or certificate file."),
    "crt": ("secret-bearing", "Key or certificate file."),
    "cer": ("secret-bearing", "Key or certificate file."),
    "keystore": ("secret-bearing", "Key or certificate file."),
    "jks": ("secret-bearing", "Key or certificate file."),
}

# Names that commonly carry credentials.
EXCLUDED_NAMES = {
    ".npmrc": ("secret-bearing", "May contain registry auth tokens."),
    ".netrc": ("secret-bearing", "Stores machine credentials."),
    ".pgpass": ("secret-bearing", "Stores database passwords."),
    "id_rsa": ("secret-bearing", "Private SSH key."),
    "id_ed25519": ("secret-bearing", "Private SSH key."),
    "credentials": ("secret-bearing", "Credential file."),
    ".htpasswd": ("secret-bearing", "Password file."),
}
ENV_REASON = ("secret-bearing", "Environment file; may contain live secrets.")
ENV_ALLOWED = ("example", "sample", "template", "dist")
MINIFIED_REASON = ("generated", "Minified bundle.")
LOCKFILE_REASON = ("generated", "Dependency lockfile.")
LOCKFILE_PREFIX = r"^(package-lock|pnpm-lock|yarn\.lock|composer\.lock|poetry\.lock|Gemfile\.lock)"

MINIFIED_LINE_LENGTH = 2000
BINARY_SAMPLE = 8192

# Words that carry no search meaning.
STOP_WORDS = (
    "a",
    "an",
    "the",
    "is",
    "are",
    "was",
    "were",
    "be",
    "been",
    "being",
    "do",
    "does",
    "did",
    "doing",
    "have",
    "has",
    "had",
    "can",
    "could",
    "will",
    "would",
    "should",
    "what",
    "where",
    "when",
    "why",
    "how",
    "who",
    "which",
    "this",
    "that",
    "these",
    "those",
    "i",
    "we",
    "you",
    "it",
    "and",
    "or",
    "but",
    "if",
    "then",
    "else",
    "for",
    "to",
    "of",
    "in",
    "on",
    "at",
    "by",
    "with",
    "from",
    "about",
    "into",
    "our",
    "me",
    "my",
)
#: White space as the source text's language has it (Java's own class is ASCII only).
SPACE_CHARS = "\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACE_CHARS}]"
BOM = "\ufeff"
