"""Image operators over streams of frames."""
