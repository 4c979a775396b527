"""Names, extensions and words that the operators go by, as data."""

from __future__ import annotations

#: Extensions of text files.
TEXT_EXTENSIONS = frozenset(
    """
    c d h m r s v cl cs el ex fs go hs j2 jl js kt md mk ml mm nu pl pm pp py rb rs sh ss sv tf ts ada asm awk bat
    bib bzl cbl cfg cjs clj cmd cob cpp csh css csv edn ejs elm env erb erl exs f03 f90 f95 fbs fnl hbs hcl hpp
    htm inf ini jsx kdl ksh kts lua mak man mjs mli nim nix njk org pas php pkl pod ps1 pug reg rkt ron rst sbt
    scm sed sls sml sql svh tcl tex tsv tsx txt typ vhd vue xib xml yml zig zsh adoc avsc bash bats cljc cljs conf
    dart diff fish haml html jade java json just less lisp path psm1 rego sass scss slim styl toml twig vhdl yaml
    astro bazel capnp cmake dhall hocon jinja json5 jsonc jsonl mount patch plist proto robot rules scala swift
    timer config gradle jinja2 liquid ndjson prisma socket svelte thrift feature graphql jsonnet pbxproj postcss
    service textile markdown mustache gitignore properties storyboard dockerignore editorconfig entitlements
    gitattributes xcworkspacedata
    """.split()
)

#: Extensions of files that are never text.
BINARY_EXTENSIONS = frozenset(
    """
    a o 7z db gz so xz aac apk app avi bin bmp bz2 cab com deb dll dmg doc eot exe flv gif ico img ipa iso jpg lib
    lz4 m4a m4v map mdb mkv mov mp3 mp4 mpg msi obj odp ods odt ogg otf pdf png ppt psd pyc pyo rar raw rpm svg
    swf tar tif ttf vhd wav wma wmv xls zip zst avif docx flac heic heif jpeg lock lzma mpeg opus pptx snap tiff
    vmdk wasm webm webp woff xlsx class dylib lockb qcow2 woff2 db-shm db-wal sqlite flatpak sqlite3 db-journal
    sqlite-shm sqlite-wal eslintcache tsbuildinfo sqlite-journal stylelintcache
    """.split()
)

#: Lock and system files.
LOCK_FILES = frozenset(
    """
    go.sum bun.lock thumbs.db yarn.lock cargo.lock ntuser.dat desktop.ini poetry.lock gemfile.lock composer.lock
    pnpm-lock.yaml gradle.lockfile package-lock.json packages.lock.json npm-shrinkwrap.json
    """.split()
)

#: Folders of Python environments and their caches.
VENV_NAMES = frozenset(
    """
    env .env .nox .tox eggs venv .eggs .venv conda lib64 pyenv .conda .pipenv .poetry anaconda anaconda3 miniconda
    miniconda3 virtualenv .mypy_cache .ruff_cache __pycache__ virtual_env virtualenvs .pytest_cache site-packages
    pip-wheel-metadata
    """.split()
)

#: Names without an extension that are text.
TEXT_NAMES = frozenset(
    """
    todo readme appfile authors capfile gemfile license podfile brewfile fastfile justfile makefile procfile
    rakefile taskfile thorfile tiltfile berksfile buildfile changelog earthfile guardfile snakefile codeowners
    dockerfile modulefile puppetfile jenkinsfile vagrantfile contributors
    """.split()
)

#: Hidden files that are read all the same.
DOT_FILES = frozenset(
    """
    .nvmrc .flake8 .mcp.json .pylintrc .gitignore .clang-tidy .env.sample .gitmodules .travis.yml .env.example
    .clang-format .dockerignore .editorconfig .env.template .eslintignore .node-version .ruby-version
    .gitattributes .gitlab-ci.yml .tool-versions .prettierignore .python-version .pre-commit-config.yaml
    """.split()
)

#: Names too common to link files by.
NAME_STOPWORDS = frozenset(
    """
    fmt get len new run set call data drop from init into iter main next open read self test this build clone
    close index setup value write render update default to_string
    """.split()
)

#: Files at which reading a project starts.
ENTRY_NAMES = frozenset(
    """
    main.rs
    go.mod lib.rs mod.rs app.tsx main.py index.js index.ts makefile index.tsx cargo.toml dockerfile __init__.py
    package.json pyproject.toml
    """.split()
)

#: Folders that are never entered, besides "system volume information".
PRUNED_FOLDERS = frozenset(
    """
    .hg .vs obj out x64 x86 .aws .bzr .git .npm .ssh .svn dist .idea .next .nuxt .yarn build debug .cache .cargo
    .gnupg .turbo _build target vendor .output .vercel .vscode htmlcov release .netlify __macosx coverage packages
    .coverage .ds_store .terraform .corpusmill .docusaurus .nyc_output .pnpm-store .serverless .svelte-kit
    $recycle.bin node_modules .parcel-cache __generated__ bower_components storybook-static
    """.split()
)

DOT_FILE_PREFIXES = (".babelrc", ".eslintrc", ".prettierrc", ".stylelintrc")
DOT_FOLDERS = frozenset({".devcontainer", ".github"})

#: A match or line with one of these is a placeholder, not a secret.
PLACEHOLDERS = tuple(
    sorted("changeme change_me dummy example getenv import.meta insert_ os.environ placeholder process.env sample todo xxxx your- your_ yourkey < ${ {{".split())
)
#: Words that open the window in which bare credentials are looked for.
CONTEXT_WORDS = tuple("api key;api-key;apikey;app pw;app-pw;credential;gmail;login;passcode;password".split(";"))
#: Words that make a whole file one about logins.
LOGIN_WORDS = tuple(" login;2fa;app password;app-password;authenticator;backup code;credential;gmail;password;recovery code".split(";"))
LINE_WORDS = tuple("app pw;app-pw;gmail;login;password".split(";"))
#: Extensions of documents and data, as opposed to source code.
DATA_EXTENSIONS = frozenset("cfg conf csv env ini json log markdown md rtf text toml tsv txt xlsx yaml yml".split())
DATA_MARKERS = ("api-key", "api_key", "apikey", "credential", "passwd", "password", "secret", "vault")
KEY_EXTENSIONS = frozenset("jks key keystore p12 pem pfx".split())
CREDENTIAL_STORES = frozenset(".htpasswd .netrc .npmrc .pgpass _netrc credentials.json htpasswd secrets.json secrets.yaml secrets.yml service-account.json".split())
