"""Line-oriented graph formats."""
