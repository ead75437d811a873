"""What paths are: directories by ordered rules, files by their names and extensions, and which duplicates are worth a question."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths


@dataclass(frozen=True)
class Rule:
    """One of: names (the last part), whole (the path), home (a place in the home directory), holds (a piece of the path), ends.
    beside and inside: names of which one has to lie in the same directory, or in the path itself; with both, either will do."""

    label: str
    category: str
    policy: str
    names: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()
    home: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    beside: tuple[str, ...] = ()
    inside: tuple[str, ...] = ()

    def condition(self, path: Column, home: str, near: Column, within: Column) -> Column:
        places = [*self.whole, *(f"{home}/{h}" for h in self.home if home)]
        told = [
            *([paths.basename(path).isin(*self.names)] if self.names else []), *([path.isin(*places)] if places else []),
            *[F.contains(path, F.lit(h)) for h in self.holds], *[F.endswith(path, F.lit(e)) for e in self.ends],
        ]
        marks = [*([_any(near, self.beside)] if self.beside else []), *([_any(within, self.inside)] if self.inside else [])]
        named = bool(self.names or self.whole or self.home or self.holds or self.ends)
        parts = [*([reduce(Column.__or__, told) if told else F.lit(False)] if named else []), *([reduce(Column.__or__, marks)] if marks else [])]
        return reduce(Column.__and__, parts)


def _any(names: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, wanted)))


#: What directories are. The first rule that holds decides.
RULES = (
    Rule("Node.js dependencies", "build-artifact", "skip", names=("node_modules",)),
    Rule("Rust build output", "build-artifact", "skip", names=("target",), beside=("Cargo.toml",), inside=("CACHEDIR.TAG",)),
    Rule("Python virtual environment", "build-artifact", "skip", names=(".venv", "venv", ".virtualenv")),
    Rule("Python bytecode cache", "build-artifact", "skip", names=("__pycache__",)),
    Rule("Gradle cache", "build-artifact", "skip", names=(".gradle",)),
    Rule("Next.js build cache", "build-artifact", "skip", names=(".next",)),
    Rule("JS/Python build output", "build-artifact", "skip", names=("dist",), beside=("package.json", "setup.py", "pyproject.toml")),
    Rule("CocoaPods dependencies", "build-artifact", "skip", names=("Pods",), beside=("Podfile",)),
    Rule("Vendored dependencies", "build-artifact", "skip", names=("vendor",), beside=("go.mod", "composer.json", "Gemfile")),
    Rule("Build output", "build-artifact", "skip", names=("build",), beside=("CMakeLists.txt", "Makefile", "meson.build", "build.gradle", "pom.xml")),
    Rule("Virtual filesystem", "system", "skip", whole=("/proc", "/sys", "/dev", "/run", "/tmp")),
    Rule("User cache", "cache", "skip", home=(".cache",)),
    Rule("Snap packages", "apps", "skip", home=("snap",)),
    Rule("Flatpak app data", "apps", "skip", holds=("/.var/app",)),
    Rule("User config files", "config", "structure", home=(".config",)),
    Rule("User data (XDG_DATA_HOME)", "data", "structure", home=(".local/share",)),
    Rule("App state (XDG_STATE_HOME)", "cache", "skip", home=(".local/state",)),
    Rule("User binaries", "applications", "structure", home=(".local/bin",)),
    Rule("SSH keys", "sensitive", "sensitive", home=(".ssh",)),
    Rule("GPG keyring", "sensitive", "sensitive", home=(".gnupg",)),
    Rule("AWS credentials", "sensitive", "sensitive", home=(".aws",)),
    Rule("macOS Keychains", "sensitive", "sensitive", holds=("Library/Keychains",)),
    Rule("Chrome profile", "sensitive", "sensitive", holds=("Application Support/Google/Chrome",)),
    Rule("Brave profile", "sensitive", "sensitive", holds=("Application Support/BraveSoftware",)),
    Rule("Firefox profile", "sensitive", "sensitive", holds=("Application Support/Firefox",)),
    Rule("Safari data", "sensitive", "sensitive", holds=("Application Support/com.apple.Safari",)),
    Rule("Mozilla profile", "sensitive", "sensitive", home=(".mozilla",)),
    Rule("pass password store", "sensitive", "sensitive", home=(".password-store",)),
    Rule("1Password data", "sensitive", "sensitive", holds=("Group Containers/2BUA8C4S2C.com.agilebits",)),
    Rule("macOS caches", "system", "skip", holds=("Library/Caches",)),
    Rule("macOS app support data", "system", "structure", holds=("Library/Application Support",)),
    Rule("Trash", "system", "skip", holds=(".local/share/Trash", ".Trash")),
    Rule("Installed applications", "applications", "structure", whole=("/Applications",), home=("Applications",)),
    Rule("Rust project", "code", "index", beside=("Cargo.toml",)),
    Rule("JavaScript/TypeScript project", "code", "index", beside=("package.json",)),
    Rule("Python project", "code", "index", beside=("pyproject.toml", "setup.py")),
    Rule("Git repository", "code", "index", inside=(".git",)),
    Rule("Documents", "documents", "index", home=("Documents",)),
    Rule("Downloads", "scratch", "index", home=("Downloads",)),
    Rule("Desktop", "scratch", "index", home=("Desktop",)),
    Rule("Pictures", "media", "index", home=("Pictures",)),
    Rule("Videos", "media", "index", home=("Movies", "Videos")),
    Rule("Music", "media", "index", home=("Music",)),
    Rule("Photos Library", "media", "structure", ends=(".photoslibrary",)),
    Rule("Final Cut Pro library", "media", "structure", ends=(".fcpbundle",)),
    Rule("Lightroom catalog", "media", "structure", ends=(".lrcat", ".lrdata")),
)

#: Files that hold secrets, by name, beginning and extension.
SECRET_NAMES = (".env", ".npmrc", ".netrc", ".pgpass", ".htpasswd", ".git-credentials", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519")
SECRET_BEGINNING, SECRET_EXTENSIONS = ".env.", ("env", "pem", "p12", "pfx")
#: Categories of files by whole names.
BY_NAME = {
    "code": "Makefile GNUmakefile Rakefile Gemfile Dockerfile Containerfile Justfile justfile Vagrantfile",
    "documents": "LICENSE LICENCE NOTICE COPYING AUTHORS CONTRIBUTORS README CHANGELOG CHANGES INSTALL TODO FIXME",
    "config": ".gitignore .gitattributes .gitmodules .dockerignore .editorconfig .yarnrc .nvmrc .node-version .python-version .ruby-version .tool-versions",
    "lockfile": "Cargo.lock package-lock.json pnpm-lock.yaml yarn.lock go.sum poetry.lock Pipfile.lock Gemfile.lock composer.lock mix.lock flake.lock",
}
#: Categories of files by extension.
BY_EXTENSION = {
    "config": "toml yaml yml ini conf cfg properties plist hcl tf tfvars",
    "lockfile": "lock sum",
    "data": "db sqlite sqlite3 duckdb parquet arrow lance mdb accdb csv tsv jsonl ndjson avro orc feather npy npz h5 hdf5 pkl pickle dta sav",
    "archive": "zip tar gz bz2 xz zst 7z rar br lz4 lzma cab iso dmg pkg",
    "font": "ttf otf woff woff2 eot pfb pfm afm",
    "code": "ipynb sh bash zsh fish ksh csh tcsh ps1 psm1 psd1 bat cmd vbs html htm css scss sass less vue svelte astro graphql gql proto json5 jsonc sol jl lua clj cljs edn ex exs erl hrl hs ml mli scala kt kts swift dart nim zig rmd",
    "logs": "log",
}
#: Categories by further extensions, where the first table has none: what their media types or languages are.
BY_TYPE = {
    "media": "png jpg jpeg jpe jfif gif bmp dib tif tiff webp ico svg svgz avif heic heif psd jp2 jxl tga pcx pbm pgm ppm pnm xbm xpm ras cr2 nef arw dng "
    "mp3 wav flac aac m4a ogg oga opus aif aiff aifc wma mid midi amr au snd ra mka weba mp4 m4v mov qt avi mkv webm wmv flv mpg mpeg mpe 3gp 3g2 ogv asf f4v",
    "documents": "pdf doc dot docx dotx docm epub odt ods odp xls xlsx xlsm xlsb xlt ppt pptx pptm pps ppsx org adoc asciidoc textile pod rdoc mediawiki",
    "code": "rs go java c h cpp cc cxx hpp hh hxx inl cs rb php py pyw pyi js mjs cjs jsx ts tsx cts coffee m mm pl pm r f f90 f95 pas asm s vb fs fsx fsi groovy gradle sql "
    "json map xml xsl xslt xsd rng txt text md markdown rst tex bib diff patch cmake mk elm lisp el scm rkt vhd vhdl sv awk tcl d adb ads cr hx pug haml erb ejs hbs mustache styl ics vcf vtt srt ttl n3 wat rtf ps",
    "data": "geojson topojson har webmanifest",
}

#: Extensions of assets, pieces of generated paths, and files that every project has.
ASSETS = "png jpg jpeg webp gif bmp tiff tif ico icns svg heic pdf mp4 mov avi mkv webm mp3 wav flac woff woff2 ttf otf eot zip gz tar bin wasm class o a dylib so lock".split()
GENERATED = (
    ".xcassets/", "/icons/", "/assets/", "/dist/", "/build/", "/node_modules/", "/vendor/", "/.next/", "/target/", "/competitors/", "/gen/", "/SourcePackages/", ".xcframework", "/DerivedData/", "/Pods/", "/.gradle/",
)
MANIFESTS = ("Cargo.toml", "package.json", "go.mod", "pyproject.toml", "Gemfile", "composer.json", "Package.swift", "pubspec.yaml")


def extensions() -> dict[str, str]:
    """Every known extension's category. The same on every machine: nothing but the tables tells."""
    return {e: c for table in (BY_TYPE, BY_EXTENSION) for c, es in table.items() for e in es.split()}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]), key)


def file_category(path: Column, content: Column | None = None) -> Column:
    """The category of files by whole names, then extensions; null where nothing tells. Where the content is given, a file that
    nothing else tells and that begins with an interpreter's line is code."""
    name, ending = paths.basename(path), paths.extension(path)
    secret = name.isin(*SECRET_NAMES) | F.startswith(name, F.lit(SECRET_BEGINNING))
    script = F.when(content.rlike(r"^#! *\S"), "code") if content is not None else F.lit(None).cast("string")
    named = _lookup({n: c for c, ns in BY_NAME.items() for n in ns.split()}, name)
    return F.when(secret, "sensitive").when(named.isNotNull(), named).when(ending.isin(*SECRET_EXTENSIONS), "sensitive").otherwise(F.coalesce(_lookup(extensions(), ending), script))


def file_policy(category: Column) -> Column:
    """Secrets are never summarised or embedded; what has no category has no policy."""
    return F.when(category == "sensitive", "sensitive").when(category.isNotNull(), "index")


def directory_hints(directories: DataFrame, entries: DataFrame, home: str = "", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, label, category, policy) of directories that a rule knows. entries: (path, parent_path), from which come the names
    beside and inside that rules ask for; a directory's array holds those alone, so it is as short as the rules. Null paths and
    repeated rows give nothing more."""
    markers = sorted({n for r in rules for n in (*r.beside, *r.inside)})
    marks = entries.select("parent_path", paths.basename("path").alias("name")).where(F.col("name").isin(*markers)) if markers else entries.select("parent_path", F.lit("").alias("name")).where("false")
    marks = marks.groupBy("parent_path").agg(F.collect_set("name").alias("names"))
    rows = directories.select("path").where("path IS NOT NULL").distinct().withColumn("up", F.coalesce(paths.parent("path"), F.lit("")))
    rows = rows.join(marks.select(F.col("parent_path").alias("up"), F.col("names").alias("near")), "up", "left").join(marks.select(F.col("parent_path").alias("path"), F.col("names").alias("within")), "path", "left")
    none = F.array().cast("array<string>")
    near, within = F.coalesce("near", none), F.coalesce("within", none)
    hint = F.coalesce(*[F.when(r.condition(F.col("path"), home, near, within), F.struct(*[F.lit(v).alias(n) for n, v in (("label", r.label), ("category", r.category), ("policy", r.policy))])) for r in rules])
    return rows.select("path", hint.alias("hint")).where("hint IS NOT NULL").select("path", "hint.*")


def actionable(files: DataFrame, cluster: str = "cluster", path: str = "path") -> DataFrame:
    """(cluster, actionable, siblings, same_name, same_parent) of clusters of duplicates (cluster, path), by sums over members: a cluster
    isn't worth a question if all are assets or any is generated; siblings: all are manifests that projects have anyway (noise unless
    exact copies in one directory); same_name: what near copies need."""
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    name = paths.basename(p)
    rows = files.where(F.col(path).isNotNull()).select(
        cluster, name.alias("name"), F.coalesce(paths.parent(p), F.lit("")).alias("parent"), paths.extension(p).isin(*ASSETS).alias("asset"),
        reduce(Column.__or__, [F.contains(p, F.lit(g)) for g in GENERATED]).alias("generated"), F.lower(name).isin(*[m.lower() for m in MANIFESTS]).alias("manifest"),
    )
    same = lambda c: F.min(c) == F.max(c)
    return rows.groupBy(cluster).agg((~(F.bool_and("asset") | F.bool_or("generated"))).alias("actionable"), F.bool_and("manifest").alias("siblings"), same("name").alias("same_name"), same("parent").alias("same_parent"))
