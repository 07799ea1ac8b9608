from .driver import bind_default_renderers, render_explained_path, render_path, render_subgraph, render_trace

__all__ = ["bind_default_renderers", "render_explained_path", "render_path", "render_subgraph", "render_trace"]
