"""Small programs, each with several calls that block and several that do not, and what is found in them.

A line that is reported ends in ``#~ CODE@COLUMN chain`` (more than one after ``|``, in order).  Sections begin with
``== path``; messages of warnings stand in a section ``== !``.
"""

import re

CONF = "[tool.latchgraph]\n"

# name: (files, exit code, diagnostics, warnings)
PROJECTS: dict[str, tuple[dict[str, str], int, list[tuple], list[str]]] = {}


def project(name: str, text: str, config: str = "", code: int | None = None) -> None:
    files = {}
    for part in re.split(r"^== ", text.lstrip("\n"), flags=re.M)[1:]:
        path, body = part.split("\n", 1)
        files[path.strip()] = body.rstrip("\n") + "\n"
    warnings = files.pop("!", "").splitlines()
    found = []
    for path in sorted(files):
        for number, line in enumerate(files[path].split("\n"), 1):
            for mark in line.split("#~")[1].split("|") if "#~" in line else ():
                kind, column, chain = re.fullmatch(r"\s*(\d+)@(\d+) (.*?)\s*", mark).groups()
                found.append((kind, path, number, int(column), chain))
    PROJECTS[name] = ({"pyproject.toml": CONF + config, **files}, int(bool(found)) if code is None else code, found, warnings)


project(
    "printer_queue",  # calls in the async function itself, and in plain functions that only other code calls
    """
== main.py
import subprocess
import urllib.request

SPOOL = "http://printer/spool"

def offline():
    return subprocess.check_output(["lpstat"])

async def drain(jobs):
    for one in jobs:
        with urllib.request.urlopen(SPOOL) as answer:  #~ 001@14 drain > urllib.request.urlopen
            answer.read()
    if not jobs:
        subprocess.run(["lpr", "-"])  #~ 001@9 drain > subprocess.run
    return len(jobs)
""",
)
project("direct", "== main.py\nimport shutil\nasync def purge(folder):\n    if folder:\n        shutil.rmtree(folder)  #~ 001@9 purge > shutil.rmtree\n")
project("sync_only", "== main.py\nimport shutil, glob\n\ndef purge():\n    for x in glob.glob('*.tmp'):\n        shutil.rmtree(x)\n\npurge()\n")
project(
    "ledger",  # one function below several callers, each path once; a deep path, and one through a lambda-free helper
    """
== main.py
import sqlite3
import os

def connection(name="ledger.db"):
    return sqlite3.connect(name)  #~ 002@12 booked > store > connection > sqlite3.connect | 002@12 totals > connection > sqlite3.connect

def store(entry):
    db = connection()
    db.execute("insert", entry)

def audit(level):
    if level:
        return rotate(level - 1)

def rotate(level):
    return archive(level) or audit(level)

def archive(level):
    os.popen("gzip ledger.db")  #~ 002@5 nightly > audit > rotate > archive > os.popen | 002@5 nightly > rotate > archive > os.popen

async def booked(entry):
    store(entry)

async def totals():
    return connection().execute("sum")

async def nightly():
    audit(3)
    rotate(2)
""",
)
project("transitive", "== main.py\nimport glob\n\ndef names(pattern):\n    found = []\n    found += glob.glob(pattern)  #~ 002@14 listing > names > glob.glob\n    return found\n\nasync def listing():\n    return names('*.txt')\n")
project(
    "kitchen",  # executors: positional, lambda, partial, keyword arguments; the same function with and without protection
    """
== main.py
import asyncio
import functools
import requests

def order(dish, table=0):
    return requests.post("http://kitchen", dish)  #~ 002@12 rush > order > requests.post

async def serve(dish):
    loop = asyncio.get_event_loop()
    await loop.run_in_executor(None, order, dish)
    await loop.run_in_executor(None, lambda: order(dish, 3))
    await loop.run_in_executor(None, functools.partial(order, dish, table=4))
    await asyncio.to_thread(order, dish)
    await asyncio.to_thread(functools.partial(requests.get, "http://menu"))

async def rush(dish):
    waiting = asyncio.to_thread(lambda: requests.get("http://menu"))
    order(dish)
    return await waiting
""",
)
project(
    "marks",  # marks on functions and methods; the calm one wins in either order
    """
== main.py
import time
from latchgraph import blocking, non_blocking

@blocking
def render(scene):
    return [x * x for x in scene]

class Camera:
    @blocking
    def expose(self):
        return self

    @non_blocking
    def focus(self):
        time.sleep(0.001)

@non_blocking
@blocking
def first(scene):
    return scene

@blocking
@non_blocking
def second(scene):
    return scene

async def film(scene):
    camera = Camera()
    camera.focus()
    first(second(scene))
    camera.expose()  #~ 001@5 film > Camera.expose
    return render(scene)  #~ 001@12 film > render
""",
)
project("property", "== main.py\nimport requests\n\nclass Feed:\n    @property\n    def rows(self):\n        return requests.get('http://x').json()\n\n    @property\n    def title(self):\n        return 'feed'\n\nasync def job(feed: Feed):\n    shown = [feed.title, feed.rows]  #~ 003@31 job > Feed.rows > requests.get\n    feed.title\n    feed.rows  #~ 003@5 job > Feed.rows > requests.get\n    return shown\n")
project("dunder", "== main.py\nimport requests\nclass Far:\n    near = 1\n    def __str__(self):\n        return requests.get('http://x').text\n    def __repr__(self):\n        return 'Far()'\n\nasync def job(far: Far):\n    print(repr(far), far.near)\n    print(str(far))  #~ 004@11 job > Far.__str__ > requests.get\n")
project(
    "weather",  # special edges in the middle of a chain, and plain ones behind them
    """
== main.py
import socket

def probe(host):
    return socket.create_connection((host, 80))

class Station:
    @property
    def reading(self):
        return probe("station")

    def __len__(self):
        return 1 if probe("count") else 0

def average(stations: list, one: Station):
    return one.reading  #~ 003@16 report > average > Station.reading > probe > socket.create_connection

def size(one: Station):
    return len(one)  #~ 004@12 report > size > Station.__len__ > probe > socket.create_connection

async def report(one: Station):
    return average([one], one) / size(one)
""",
)
project(
    "calm_in_cycle",
    """
== main.py
import os
from latchgraph import non_blocking

def loud(n):
    if n > 0:
        calm(n - 1)
    os.system("beep")  #~ 002@5 alarm > loud > os.system

@non_blocking
def calm(n):
    return n and loud(n)

async def whisper():
    return calm(4)

async def alarm():
    return loud(2)
""",
)
project(
    "safe_and_unsafe",
    """
== main.py
import asyncio, glob

async def careful(pattern):
    return await asyncio.to_thread(matches, pattern)

async def careless(pattern):
    found = matches(pattern)
    return found or await careful(pattern)

def matches(pattern):
    yield from glob.iglob(pattern)  #~ 002@16 careless > matches > glob.iglob
""",
)
project(
    "unblockers",  # a function that hands its callable away, by position, by keyword, and one that is none
    """
== main.py
import shutil
from latchgraph import unblocker

@unblocker
def apart(task, *rest):
    return task, rest

@unblocker(callable_param="task")
def named(label, *, task):
    return label, task

@unblocker(callable_param=1)
def second(label, task):
    return label, task

def plain(task):
    return task

async def tidy():
    apart(lambda: shutil.move("a", "b"))
    named("x", task=lambda: shutil.move("a", "b"))
    second("x", lambda: shutil.move("a", "b"))
    second(lambda: shutil.move("b", "c"), None)  #~ 001@20 tidy > shutil.move
    plain(lambda: shutil.move("c", "d"))  #~ 001@19 tidy > shutil.move
""",
)
project(
    "wrappers",  # wrappers of the configuration, under other names as well
    """
== main.py
import pool
from pool import submit as later

import os.path

def present(path):
    return os.path.exists(path)

async def look(paths):
    later(os.path.isdir, paths)
    pool.submit(lambda: present(paths[0]))
    await pool.deferred(call=present, count=2)
    await pool.deferred(call=None, count=os.path.isfile(paths[1]))  #~ 001@42 look > os.path.isfile
== pool.py
def submit(call, *rest):
    return call, rest

async def deferred(*, call, count):
    return call, count
""",
    config='[tool.latchgraph.executor-wrappers]\n"pool.submit" = { callable_param = 0 }\n"pool.deferred" = { callable_param = "call" }\n',
)
project(
    "library",  # files of a package: from imports, relative ones, re-exports, star imports, folders without __init__
    """
== app/__init__.py
from .store.disk import load as fetch
== app/store/disk.py
from ..wire import *

def load(name):
    return open(name)  #~ 002@12 browse > app.store.disk.load > builtins.open

def remote(name):
    return dial(name)
== app/wire.py
import socket

_hidden = 1

def dial(name):
    return socket.create_connection((name, 1))  #~ 002@12 browse > app.store.disk.remote > app.wire.dial > socket.create_connection
== main.py
import app
from app.store import disk as d

async def browse(name):
    app.fetch(name)
    return d.remote(name)
""",
)
_HOPS = "".join(f"== h{i}.py\nfrom h{i + 1} import step\n" for i in range(40))
project("forty_hops", _HOPS + "== h40.py\nimport glob\ndef step():\n    glob.glob('x')  #~ 002@5 walk > h40.step > glob.glob\n== main.py\nfrom h0 import step\nasync def walk():\n    step()\n")
project("star_cycle", "== left.py\nfrom right import *\ndef one():\n    glob.glob('1')\n== right.py\nfrom third import *\nfrom left import *\n== third.py\nimport os\nfrom right import *\ndef two():\n    os.listdir('2')  #~ 002@5 go > third.two > os.listdir\n== main.py\nfrom left import *\nasync def go():\n    two()\n")
project("import_cycle", "== a.py\nfrom b import thing\n== b.py\nfrom a import thing\n== main.py\nfrom a import thing\nimport glob\nasync def go():\n    thing()\n    glob.glob('x')  #~ 001@5 go > glob.glob\n")
project("named_alike", "== pack/__init__.py\nfrom .scan import scan\n== pack/scan.py\nimport os\ndef scan(top):\n    return os.scandir(top)  #~ 002@12 first > pack.scan.scan > os.scandir | 002@12 second > pack.scan.scan > os.scandir\n== main.py\nfrom pack import scan as look\nfrom pack.scan import scan\nasync def first():\n    look('/')\nasync def second():\n    scan('/')\n")
project("syntax_error", "== good.py\nasync def ask():\n    return input('? ')  #~ 001@12 ask > builtins.input\n== bad.py\nclass Half(:\n== !\nSyntax error in bad.py\n")
project("long_expression", "== main.py\nimport os\nasync def f(a):\n    x = " + " + ".join(["a"] * 5000) + "\n    os.stat('y')  #~ 001@5 f > os.stat\n== other.py\nimport os\nasync def g():\n    os.stat('y')  #~ 001@5 g > os.stat\n== deep.py\nx = " + "not " * 30_000 + "x\n== !\nSyntax error in deep.py\n")
project("thousand_terms", "== main.py\nimport os\nasync def f(a):\n    x = " + " + ".join(["a"] * 1500) + "\n    os.stat('y')  #~ 001@5 f > os.stat\n")
project(
    "stub",  # marks in stubs: functions, methods, calm ones under a module that blocks as a whole
    """
== main.py
from outside import grind, Client
import old, older

async def job(c: Client):
    grind()  #~ 001@5 job > outside.grind

async def ask(c: Client):
    c.peek()
    c.fetch()  #~ 001@5 ask > outside.Client.fetch

async def legacy():
    old.quick()
    older.slow()
    old.deep.slow()  #~ 001@5 legacy > old.deep.slow
== stubs/outside.pyi
from latchgraph import blocking

@blocking
def grind() -> None: ...

class Client:
    @blocking
    def fetch(self) -> None: ...
    def peek(self) -> None: ...
== stubs/old/__init__.pyi
from latchgraph import non_blocking

@non_blocking
def quick() -> None: ...
== stubs/old/deep.pyi
def slow() -> None: ...
== stubs/older.pyi
def slow() -> None: ...
""",
    config='stub_paths = ["stubs"]\n[tool.latchgraph.blocking]\nblocking_modules = ["old"]\n',
)
PROJECTS["stub"][2].sort(key=lambda d: d[1:4])
_THREAD = "== main.py\nimport asyncio, os\nasync def scan():\n    return await asyncio.to_thread(os.listdir, '.')\n"
project("old_python", _THREAD + "== !\nasyncio.to_thread is unavailable for configured python_version 3.7; executor protection was not applied\n", config='python_version = "3.7"\n')
project("new_python", _THREAD, config='python_version = "3.15"\n')
project("untyped", "== main.py\nasync def relay(target, *more):\n    target.sleep(3)\n    more[0]()\n    (lambda: 1)()\n")
project(
    "workshop",  # methods of all kinds, objects that are called, inheritance, super(), attributes, types by annotation
    """
== main.py
import subprocess
import requests

class Tool:
    def cut(self):
        subprocess.call(["saw"])  #~ 002@9 Bench.work > Tool.cut > subprocess.call | 002@9 by_type > lend > Tool.cut > subprocess.call | 002@9 heir > Fine.cut > Tool.cut > subprocess.call | 002@9 made > Tool.cut > subprocess.call

    @staticmethod
    def oil():
        subprocess.call(["oil"])  #~ 002@9 kinds > Tool.oil > subprocess.call

    @classmethod
    def count(cls):
        subprocess.call(["wc"])  #~ 002@9 kinds > Tool.count > subprocess.call

    def __call__(self):
        subprocess.call(["run"])  #~ 004@9 called > Tool.__call__ > subprocess.call
class Fine(Tool):
    def cut(self):
        return super().cut()

class Web(requests.Session):
    pass

class Bench:
    def __init__(self):
        self.tool = Tool()

    async def work(self):
        self.tool.cut()

def lend(tool: Tool):
    tool.cut()

async def by_type(tool: "Tool | None"):
    lend(tool)

async def made():
    Tool().cut()

async def kinds():
    Tool.oil()
    Tool.count()

async def heir(tool: Fine):
    tool.cut()

async def called():
    tool = Tool()
    tool()

async def outer():
    web = Web()
    return web.get("http://x")  #~ 001@12 outer > requests.Session.get
""",
)
# an implicit call is shown where it is made, not in the method
_files, _code, _found, _warned = PROJECTS["workshop"]
_found[[d[0] for d in _found].index("004")] = ("004", "main.py", 50, 5, "called > Tool.__call__ > subprocess.call")
_found.sort(key=lambda d: d[1:4])
_OPERATORS = {"mul": "v * w", "ge": "v >= w", "contains": "3 in v", "format": "f'{v:>3}'", "getitem": "v['k']", "enter": "with v: pass", "iter": "for _ in v: pass", "invert": "~v", "bool": "not v", "iadd": "v += w"}
project(
    "operators",
    "== main.py\nimport os\n\nclass V:\n" + "".join(f"    def __{m}__(self, *a):\n        os.system('{m}')\n" for m in _OPERATORS) + "    def __exit__(self, *a): ...\n"
    + "".join(f"async def on_{m}(v: V, w: V):\n    {body}  #~ 004@5 on_{m} > V.__{m}__ > os.system\n" for m, body in _OPERATORS.items()),
)
_TABLE = "== main.py\nimport codec, os\nasync def f():\n    codec.squeeze(b'')"
_REST = "\n    os.stat('x')"
_LIB = "\n== codec.py\ndef squeeze(data):\n    return data\n"
project("added", f"{_TABLE}  #~ 001@5 f > codec.squeeze{_REST}  #~ 001@5 f > os.stat{_LIB}", config='[tool.latchgraph.blocking]\nadd = [{ name = "codec.squeeze", help = "h", category = "other" }]\n')
project("removed", f"{_TABLE}{_REST}{_LIB}", config='[tool.latchgraph.blocking]\nremove = ["os.stat"]\n')
project("added_after_removed", f"{_TABLE}{_REST}  #~ 001@5 f > os.stat{_LIB}", config='[tool.latchgraph.blocking]\nremove = ["os.stat"]\nadd = [{ name = "os.stat", help = "h", category = "file-io" }]\n')
project("roots_and_excludes", "== lib/core.py\nimport os\nasync def f():\n    os.stat('x')  #~ 001@5 f > os.stat\n== lib/gen/made.py\nimport os\nasync def g():\n    os.stat('x')\n== lib/x_test.py\nimport os\nasync def h():\n    os.stat('x')\n== tools/run.py\nimport os\nasync def i():\n    os.stat('x')\n== lib/skip.py\nimport os\nasync def j():\n    os.stat('x')\n", config='src_roots = ["lib"]\nexclude = ["lib/gen/**", "**/x_test.py", "lib/skip.py"]\n')
project("shadowed", "== main.py\nimport os\n\nclass Fake:\n    def system(self, line): ...\n\nos = Fake()\n\ndef open(name): ...\n\nasync def f():\n    os.system('x')\n    open('y')\n")
project("inherited_property", "== main.py\nimport os\nclass Top:\n    @property\n    def size(self):\n        return os.stat('t').st_size\nclass Mid(Top): ...\nclass Low(Mid):\n    pass\nasync def f(low: Low):\n    low.size  #~ 003@5 f > Top.size > os.stat\n    return low.size + 1  #~ 003@16 f > Top.size > os.stat\n")
project("lost_import", "== main.py\nfrom no_such_place_here import thing, other\nimport also_not_there\n\nasync def f():\n    thing()\n== !\nUnresolvable import: no_such_place_here\n")
project(
    "same_names",  # names alike in two files stay apart
    """
== one.py
class Queue:
    async def push(self):
        return await self.flush()

    async def flush(self):
        return 1
== two.py
import os

class Queue:
    def push(self):
        return self.flush()

    def flush(self):
        return os.read(0, 1)  #~ 002@16 drain > two.Queue.push > two.Queue.flush > os.read

async def drain():
    Queue().push()
""",
)
project("import_alias", "== main.py\nimport os as system, os.path as p\nfrom os import listdir as ls\nfrom urllib import request\nasync def f():\n    system.stat('x')  #~ 001@5 f > os.stat\n    ls()  #~ 001@5 f > os.listdir\n    request.urlopen('u')  #~ 001@5 f > urllib.request.urlopen\n    p.isfile('y')  #~ 001@5 f > os.path.isfile\n")
project("nested", "== main.py\nimport os\nasync def outer():\n    def inner():\n        os.stat('x')\n    async def own():\n        os.stat('y')  #~ 001@9 outer.own > os.stat\n    return inner, own\n")
project("self_recursion", "== main.py\nimport os\nasync def down(n):\n    if n:\n        await down(n - 1)\n    os.stat('x')  #~ 001@5 down > os.stat\n")
project("non_ascii", "== main.py\nimport os\nasync def f():\n    straße, 名 = 'ß', '名'; os.stat(straße)  #~ 001@27 f > os.stat\n")
project("boundary", "== main.py\nimport os\ndef low():\n    os.stat('x')\ndef mid():\n    return low()\nasync def f():\n    return mid()  #~ 002@12 f > mid > low > os.stat\n", config='intervention_strategy = "async-boundary"\nseverity = "warning"\n')
project("bad_strategy", "== main.py\nx = 1\n", config='intervention_strategy = "shallowest"\n', code=2)
project("no_sources", "== src/gone.py\nx = 1\n", config='src_roots = ["src"]\nexclude = ["src/**"]\n', code=3)

project(
    "handed_over",  # receivers that only the callers' arguments tell
    """
== main.py
import functools
import shutil
import socket

class Shelf:
    @property
    def books(self):
        return listing()

    def __str__(self):
        return listing()

    def __len__(self):
        return 3

def listing():
    return shutil.rmtree("/")

def count(shelf):
    return shelf.books  #~ 003@18 evening > count > Shelf.books > listing > shutil.rmtree

def label(shelf):
    return str(shelf)  #~ 004@12 morning > label > Shelf.__str__ > listing > shutil.rmtree

async def evening():
    mine = Shelf()
    count(mine)

async def morning():
    mine = Shelf()
    label(mine)
""",
)
project(
    "passed_on",  # through several calls, results, attributes, elements, alternatives and other modules
    """
== gear.py
import os

class Wheel:
    def __init__(self, hub=None):
        self.hub = hub

    @property
    def spokes(self):
        return os.listdir("/spokes")

    def turn(self):
        os.system("turn")  #~ 002@9 other_module > gear.Wheel.turn > os.system | 002@9 results > gear.Wheel.turn > os.system | 002@9 through_calls > outer > inner > gear.Wheel.turn > os.system

def spare() -> Wheel:
    return Wheel()

def either(flag):
    if flag:
        return Wheel()
    return None

shared = Wheel()

class Hub:
    def grease(self):
        os.system("grease")  #~ 002@9 attribute > greased > gear.Hub.grease > os.system

== main.py
import functools
import time
import gear

def inner(thing):
    thing.turn()

def outer(thing):
    inner(thing)

def call(job, *more):
    job()
    for one in more:
        one(2)  #~ 002@9 functions > call > time.sleep

def greased(wheel):
    wheel.hub.grease()

async def through_calls():
    outer(gear.spare())

async def chooses(x):
    y = x or gear.Wheel()
    return [y.spokes]  #~ 003@15 chooses > gear.Wheel.spokes > os.listdir

async def elements():
    wheels = [gear.Wheel(), gear.Wheel()]
    [w.spokes for w in wheels]  #~ 003@8 elements > gear.Wheel.spokes > os.listdir

async def results():
    gear.either(1).turn()
    gear.spare().turn()

async def other_module():
    gear.shared.turn()

async def functions():
    call(nap, time.sleep)

async def bound():
    if (doze := nap):
        doze()
    functools.partial(nap)()

async def attribute():
    greased(gear.Wheel(hub=gear.Hub()))

def nap():
    time.sleep(1)  #~ 002@5 bound > nap > time.sleep | 002@5 functions > call > nap > time.sleep
""",
)
project(
    "nothing_known",  # values that nobody hands over, and members that their classes lack, give nothing
    """
== main.py
import os

class Loud:
    def shout(self):
        os.system("shout")

    @property
    def volume(self):
        return os.stat("/volume").st_size

class Quiet:
    def shout(self):
        return ""

    volume = 3

def tell(speaker):
    speaker.shout()
    return speaker.volume

def never(speaker):
    speaker.shout()

def swap(first, second):
    return second

async def hush(unknown):
    tell(Quiet())
    unknown.shout()
    unknown.volume
    swap(Loud(), Quiet()).shout()
    tell(unknown.other())

async def loud():
    keep = Loud()
    keep = len("x")
    return keep
""",
)
