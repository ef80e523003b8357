from .pipeline import PipelineSpec, run  # noqa: F401
