"""Write API.md: public functions of the kiln modules with the first line of
their docstrings (python tests/apidoc.py)."""
import importlib
import inspect
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

MODULES = ["kiln.sources.files", "kiln.sources.ranges", "kiln.sources.json_ranges", "kiln.sources.xml_ranges",
           "kiln.sources.sinks", "kiln.operators.clean", "kiln.operators.convert",
           "kiln.operators.profile", "kiln.operators.sampling", "kiln.operators.textmetrics", "kiln.operators.logs",
           "kiln.operators.experiments", "kiln.operators.runs", "kiln.operators.telemetry", "kiln.streaming.live",
           "kiln.functions.text", "kiln.functions.editdistance", "kiln.functions.ranking",
           "kiln.functions.jvm", "kiln.session"]


def main():
    out = ["# API index", "", "Generated by `tests/apidoc.py` from the docstrings.", ""]
    for name in MODULES:
        mod = importlib.import_module(name)
        out.append(f"## `{name}`")
        out.append("")
        doc = (inspect.getdoc(mod) or "").split("\n\n")[0].replace("\n", " ")
        if doc:
            out.append(doc)
            out.append("")
        for fname, fn in inspect.getmembers(mod, inspect.isfunction):
            if fname.startswith("_") or fn.__module__ != name:
                continue
            first = (inspect.getdoc(fn) or "").split("\n\n")[0].replace("\n", " ")
            sig = str(inspect.signature(fn)).replace("'", "")
            if len(sig) > 90:
                sig = "(...)"
            out.append(f"* `{fname}{sig}` — {first}")
        out.append("")
    open(os.path.join(ROOT, "API.md"), "w").write("\n".join(out))


if __name__ == "__main__":
    main()
