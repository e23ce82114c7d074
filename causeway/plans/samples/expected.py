"""Rows that scan queries must give on ``SHAPES``.

Those of ``WRITTEN`` were written from the sources and the catalogue before the queries' rows were looked at. Those of ``CHECKED`` were
printed by the queries and then checked line by line against the sources: they hold the behaviour in place, and are a weaker proof.
"""

WRITTEN: dict[str, tuple[str, list[tuple]]] = {
    "m02_sources": (
        "dist_id VARCHAR, line BIGINT, source_kind VARCHAR, pattern VARCHAR",
        [
            ('origins', 2, 'environment', 'os.environ'),
            ('origins', 3, 'system_identity', 'getpass.getuser'),
            ('origins', 4, 'user_input', 'pyperclip.paste'),
            ('origins', 5, 'network_response', 'httpx'),
            ('origins', 6, 'sensitive_file', '~/.netrc'),
            ('origins', 7, 'decoded_literal', 'base64.b64decode'),
            ('origins', 9, 'decoded_literal', 'codecs.decode'),
            ('origins', 10, 'decoded_literal', '<escaped-literal>'),
            ('origins', 11, 'suspicious_literal', '<literal:url-not-index>'),
            ('origins', 13, 'suspicious_literal', '<literal:raw-ip>'),
            ('origins', 14, 'suspicious_literal', '<literal:command-with-url>'),
            ('origins', 16, 'suspicious_literal', '<literal:home-or-root-path>'),
        ],
    ),
    "m17_sinks": (
        "dist_id VARCHAR, line BIGINT, sink_kind VARCHAR, pattern VARCHAR",
        [
            ('ends', 4, 'code_execution', 'exec'),
            ('ends', 5, 'code_execution', 'eval'),
            ('ends', 6, 'code_execution', 'subprocess'),
            ('ends', 7, 'code_execution', 'os.system'),
            ('ends', 8, 'destructive_fs', 'shutil.rmtree'),
            ('ends', 9, 'process_control', 'os.dup2'),
            ('ends', 10, 'dynamic_import', '__import__'),
            ('ends', 11, 'dynamic_import', 'importlib.import_module'),
            ('ends', 12, 'network_egress', 'socket.create_connection'),
            ('ends', 13, 'persistence_write', '<write:~/.bashrc>'),
            ('ends', 14, 'persistence_write', '<write:site-packages/*.pth>'),
            ('ends', 15, 'persistence_write', '<write:/etc/cron>'),
            ('ends', 17, 'persistence_write', 'winreg.SetValueEx'),
            ('files', 6, 'code_execution', 'subprocess'),
            ('files', 7, 'code_execution', 'subprocess'),
            ('files', 7, 'code_execution', '<interpreter-stdin>'),
            ('files', 8, 'code_execution', 'subprocess'),
            ('files', 8, 'code_execution', '<interpreter-stdin>'),
            ('files', 9, 'code_execution', 'subprocess'),
        ],
    ),
}

CHECKED: dict[str, tuple[str, list[tuple]]] = {
    "n01_symbols": (
        "dist_id VARCHAR, path VARCHAR, qualified VARCHAR, kind VARCHAR, line BIGINT",
        [
            ('broken', 'broken.py', 'broken', 'module', 1),
            ('garden', 'src/garden/__init__.py', 'garden', 'module', 1),
            ('garden', 'src/garden/beds.py', 'garden.beds', 'module', 1),
            ('garden', 'src/garden/beds.py', 'garden.beds.Bed', 'class', 6),
            ('garden', 'src/garden/beds.py', 'garden.beds.Bed.dig', 'method', 8),
            ('garden', 'src/garden/beds.py', 'garden.beds.Bed.dig.deeper', 'function', 9),
            ('garden', 'src/garden/beds.py', 'garden.beds.Bed.dig.deeper.<lambda#1>', 'lambda', 10),
            ('garden', 'src/garden/beds.py', 'garden.beds.plan', 'function', 13),
            ('roots', 'roots_pkg/__init__.py', 'roots_pkg', 'module', 1),
            ('roots', 'roots_pkg/__init__.py', 'roots_pkg.start', 'function', 1),
            ('roots', 'roots_pkg/inner.py', 'roots_pkg.inner', 'module', 1),
            ('roots', 'roots_pkg/inner.py', 'roots_pkg.inner.never', 'function', 1),
            ('roots', 'roots_tasks.py', 'roots_tasks', 'module', 1),
            ('roots', 'roots_tasks.py', 'roots_tasks.deeper', 'function', 4),
            ('roots', 'roots_tasks.py', 'roots_tasks.idle', 'function', 7),
            ('roots', 'roots_tasks.py', 'roots_tasks.work', 'function', 1),
            ('roots', 'setup.py', 'setup', 'module', 1),
            ('roots', 'setup.py', 'setup.Own', 'class', 5),
            ('roots', 'setup.py', 'setup.Own.run', 'method', 6),
        ],
    ),
    "g05_call_edges": (
        "dist_id VARCHAR, caller VARCHAR, callee VARCHAR, confidence VARCHAR",
        [
            ('calls', 'calls.base.Oven.bake', 'calls.base.Oven.turn', 'resolved'),
            ('calls', 'calls.use', 'calls.base.decorate', 'resolved'),
            ('calls', 'calls.use.main', 'calls.base.Oven.__init__', 'resolved'),
            ('calls', 'calls.use.main', 'calls.base.Oven.bake', 'resolved'),
            ('calls', 'calls.use.main', 'calls.base.Pan.fry', 'ambiguous'),
            ('calls', 'calls.use.main', 'calls.base.Wok.fry', 'ambiguous'),
            ('calls', 'calls.use.main', 'calls.base.helper', 'resolved'),
            ('hub', 'hub.run', 'hub.C0.go', 'ambiguous'),
            ('hub', 'hub.run', 'hub.C1.go', 'ambiguous'),
            ('hub', 'hub.run', 'hub.C2.go', 'ambiguous'),
            ('hub', 'hub.run', 'hub.C3.go', 'ambiguous'),
            ('hub', 'hub.run', 'hub.C4.go', 'ambiguous'),
            ('hub', 'hub.run', 'hub.C5.go', 'ambiguous'),
            ('hub', 'hub.run', 'hub.C6.go', 'ambiguous'),
            ('hub', 'hub.run', 'hub.C7.go', 'ambiguous'),
            ('hub', 'hub.run', 'hub.C8.go', 'ambiguous'),
            ('hub', 'hub.run', 'hub.C9.go', 'ambiguous'),
            ('roots', 'roots_pkg', 'roots_pkg.start', 'resolved'),
            ('roots', 'roots_tasks.work', 'roots_tasks.deeper', 'resolved'),
            ('roots', 'setup.Own.run', 'roots_tasks.work', 'resolved'),
        ],
    ),
    "r01_receivers": (
        "dist_id VARCHAR, path VARCHAR, line BIGINT, label VARCHAR",
        [
            ('calls', 'calls/base.py', 20, 'json.dumps'),
            ('calls', 'calls/base.py', 7, 'calls.base.Oven.turn'),
            ('calls', 'calls/use.py', 10, 'calls.base.helper'),
            ('calls', 'calls/use.py', 11, 'getattr'),
            ('calls', 'calls/use.py', 11, 'os.system'),
            ('calls', 'calls/use.py', 12, "threading.Thread(target=helper, args=('x',)).start"),
            ('calls', 'calls/use.py', 12, 'threading.Thread'),
            ('calls', 'calls/use.py', 13, '<dynamic>'),
            ('calls', 'calls/use.py', 13, '<dynamic>'),
            ('calls', 'calls/use.py', 14, 'calls.base.helper'),
            ('calls', 'calls/use.py', 7, 'calls.base.Oven.__init__'),
            ('calls', 'calls/use.py', 8, 'calls.base.Oven.bake'),
            ('calls', 'calls/use.py', 9, 'thing.fry'),
            ('types', 'types_/__init__.py', 12, 'socket.socket.send'),
            ('types', 'types_/__init__.py', 13, 'discord.SyncWebhook.send'),
            ('types', 'types_/__init__.py', 14, 'self.mixed.send'),
            ('types', 'types_/__init__.py', 17, 'socket.socket'),
            ('types', 'types_/__init__.py', 18, 'socket.socket.connect'),
            ('types', 'types_/__init__.py', 21, 'socket.socket'),
            ('types', 'types_/__init__.py', 22, 'open'),
            ('types', 'types_/__init__.py', 23, 's.connect'),
            ('types', 'types_/__init__.py', 5, 'socket.socket'),
            ('types', 'types_/__init__.py', 7, 'socket.socket'),
            ('types', 'types_/__init__.py', 9, 'discord.SyncWebhook.from_url'),
        ],
    ),
    "h01_phase_roots": (
        "dist_id VARCHAR, phase VARCHAR, kind VARCHAR, symbol VARCHAR",
        [
            ('garden', 'import', 'init', 'garden'),
            ('hub', 'import', 'module', 'hub'),
            ('roots', 'import', 'init', 'roots_pkg'),
            ('roots', 'import', 'module', 'roots_tasks'),
            ('roots', 'install', 'cmdclass', 'setup.Own.run'),
            ('roots', 'install', 'setup_py', 'setup'),
        ],
    ),
}

ROWS = WRITTEN | CHECKED
