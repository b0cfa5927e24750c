"""Frame-stream analytics on Spark: declarative graphs of samplers, filters, branches, analyzers, joins and triggers, compiled to DataFrame plans."""

from .functions import observation, signals, trigger
from .modules import ColumnModule, FusionModule, Module, Path, PythonModule, extractor, fusion, python_extractor
from .operators.fusion import decision
from .plans.builder import FlowGraphBuilder
from .plans.compiler import NodeProcessingError, compile_graph
from .plans.graph import FlowGraph
from .runner import process, process_video

__version__ = "0.1.0"
__all__ = ["ColumnModule", "FlowGraph", "FlowGraphBuilder", "FusionModule", "Module", "NodeProcessingError", "Path", "PythonModule", "compile_graph", "decision", "extractor", "fusion", "observation", "process", "process_video", "python_extractor", "signals", "trigger"]
